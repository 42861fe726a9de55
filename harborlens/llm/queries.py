"""The queries over the corpus tables: each applies one operator to its whole table and returns the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlens.llm.bpe import bpe_digests
from harborlens.llm.common import shared_folder, table
from harborlens.llm.conversations import COST, damage, repair_report
from harborlens.llm.decontaminate import benchmark_spans, contaminated
from harborlens.llm.exact_dedup import exact_dedup
from harborlens.llm.importance import resample
from harborlens.llm.license_scan import WORD, brute_force_sql, license_scan
from harborlens.llm.line_dedup import line_dedup
from harborlens.llm.lm_score import brute_force_sql as lm_sql
from harborlens.llm.lm_score import lm_scores
from harborlens.llm.quality import quality
from harborlens.llm.sharding import shard
from harborlens.llm.simhash import near_duplicates
from harborlens.llm.toxicity import toxicity
from harborlens.llm.warc import read_warc, write_warc


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = docs.withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    return exact_dedup(docs, carry=["text_sha256"])


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), labels=table(spark, sf_dir, "labels"))


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm_scores(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.round(c, 6) for c in ("log_score", "mean_log_score")})


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit(""))))
    return shard(docs, 24, carry=["text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    number = lambda c: F.regexp_extract(c, r"^<urn:x-page:(-?\d+)>$", 1).try_cast("long")
    return read_warc(spark, path, with_payload=False).select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), "ok"
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = benchmark_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return met.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), tokenizer_file())


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return repair_report(damage(turns), turns)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Trimmed, and A-Z alone in lower case.
_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Five hexadecimal digits are four of base 32.
_BASE32 = "array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast(list_sum(list_transform(range(0, 5), lambda k: (instr('0123456789abcdef', substr(h, 1 + 5 * (i // 4) + k, 1)) - 1) * 16 ** (4 - k))) as bigint) // cast(32 ** (3 - i % 4) as bigint) % 32, 1)), '')"
_KEY_SQL = (
    "translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), "
    "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
)

QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_simhash": op2_simhash,
    "op3_line_dedup": op3_line_dedup,
    "op4_quality": op4_quality,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_lm_scores": op6_lm_scores,
    "op7_sharding": op7_sharding,
    "op8_warc": op8_warc,
    "op9_decontamination": op9_decontamination,
    "op10_bpe": op10_bpe,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_toxicity": op13_toxicity,
}

#: The table of CRC-32 as a list, and the checksum of a string by it.
_CRC_TABLE = "crcs as (select list_transform(range(0, 256), lambda i: list_reduce(list_prepend(i, range(0, 8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as crc)"
_HEX = "hex(encode({0}))"
_CRC = f"xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, length({_HEX}) // 2), lambda i: ((instr('0123456789ABCDEF', substr({_HEX}, 2 * i + 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr({_HEX}, 2 * i + 2, 1)) - 1)::bigint)), lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])))"


def _repair_sql() -> str:
    """DuckDB SQL for op11: from the last row of a conversation to its first, the least (cost, edits, repaired rows) from each of the grammar's states."""
    keep, rerole, delete, insert = (COST[e] for e in "KRDI")
    way = lambda cost, edit, said, to: f"{{'c': {cost} + x[{to + 1}].c, 'e': '{edit}' || x[{to + 1}].e, 't': list_concat({said}, x[{to + 1}].t)}}"
    never = "{'c': 1000000000, 'e': '', 't': []::varchar[]}"
    to, makes = (2, 2, 3, 2), ("user", "user", "assistant", "user")
    own = []
    for q, kept in enumerate(({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})):
        keeps = " ".join(f"when not gone and left(role, 1) = '{s}' then {way(f'{keep} + more', 'K', '[said]', k)}" for s, k in kept.items())
        rerolled = way(f"{rerole} + more", "R", f"['{makes[q]}:' || text]", to[q])
        own.append(f"list_min([case {keeps} else {never} end, case when gone then {never} else {rerolled} end, {way(delete, 'D', '[]::varchar[]', q)}])")
    put = lambda n, q, made, k: f"{{'c': y[{k + 1}].c + {n * insert}, 'e': '{'I' * n}' || y[{k + 1}].e, 't': list_concat({made}, y[{k + 1}].t)}}"
    before = [f"list_min([y[{q + 1}], {put(1, q, [makes[q] + ':'], to[q])}, {put(2, q, [makes[q] + ':', makes[to[q]] + ':'], to[to[q]])}])" for q in range(4)]
    return f"""
        with recursive {_CRC_TABLE},
        hurt as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {_CRC.format("k")} % 20 as kind
            from (select *, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations), crcs),
        rows as (select conv_id, turn, case when kind = 4 then 'user' else role end as role,
            case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(0, case kind when 3 then 2 else 1 end)) as copy
            from hurt where kind <> 0),
        placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i, count(*) over (partition by conv_id) as n,
            rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as ended from rows),
        faulty as (select *, lag(role) over (partition by conv_id order by i) as before, case when ended = '' then 'blank'
            when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate' when right(ended, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault from placed),
        coded as (select *, role || ':' || text as said, fault in ('blank', 'duplicate') as gone, case fault when 'truncated' then 3 else 0 end as more from faulty),
        walk as (select conv_id, n + 1 as i, [{{'c': 0, 'e': '', 't': []::varchar[]}}, {{'c': 6, 'e': 'II', 't': ['user:', 'assistant:']}}, {{'c': 3, 'e': 'I', 't': ['assistant:']}}, {{'c': 0, 'e': '', 't': []::varchar[]}}] as x
            from coded where i = n union all
            select conv_id, i, [{", ".join(before)}] from (select c.conv_id, c.i, [{", ".join(own)}] as y from walk w join coded c on c.conv_id is not distinct from w.conv_id and c.i = w.i - 1)),
        best as (select conv_id, x[1] as b from walk where i = 1),
        told as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
            count(*) filter (fault = 'truncated') as truncated, count(*) filter (before is not null and left(before, 1) || left(role, 1) not in ('su', 'ua', 'au')) as illegal from coded group by conv_id)
        select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
            coalesce(b.c, 0)::bigint as cost, coalesce(b.e, '') as audit, sha256(coalesce(array_to_string(b.t, chr(10)), '')) as repaired_sha256
        from (select distinct conv_id from conversations) o left join told t on t.conv_id is not distinct from o.conv_id left join best w on w.conv_id is not distinct from o.conv_id"""


ORACLES = {
    "op1_license_scan": brute_force_sql(),
    "op3_line_dedup": f"""
        with rows as (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents),
        lines as (select doc_id, unnest(parts) as line, unnest(range(len(parts))) as pos from rows),
        keyed as (select doc_id, pos, line, {_KEY_SQL} as k from lines),
        held as (select k, min(doc_id) as first_doc from keyed where length(k) >= 10 group by k having count(distinct doc_id) >= 2),
        marked as (select l.doc_id, l.pos, l.line, h.k is not null and l.doc_id <> h.first_doc as gone from keyed l left join held h on l.k = h.k)
        select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
               sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
        from marked group by doc_id""",
    "op6_lm_scores": lm_sql(),
    "op8_warc": f"""
        with p as (select page_id, coalesce(html, '') as body, sha1(coalesce(html, '')) as h, min(page_id) over (partition by coalesce(html, '')) as first from pages)
        select page_id, strlen(body)::bigint as payload_bytes, {_BASE32} as payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type,
            case when page_id <> first then first end as refers_to, true as ok from p""",
    "op9_decontamination": f"""
        with d as (select doc_id, regexp_extract_all({_LOWER.format('text')}, '{WORD}') as ws from documents),
        b as (select item_id::varchar as item, regexp_extract_all({_LOWER.format('text')}, '{WORD}') as ws from benchmark where item_id is not null),
        s as (select item, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) as p from b where len(ws) > 0),
        windows as (select distinct item, least(len(ws), 13) as n, array_to_string(ws[p : p + 12], ' ') as w from s),
        starts as (select doc_id, ws, unnest(range(1, len(ws) + 1)) as p from d),
        met as (select doc_id, p, n, item from (select doc_id, p, n, array_to_string(ws[p : p + n - 1], ' ') as w from starts, (select distinct n from windows) l where p + n - 1 <= len(ws)) x join windows using (n, w)),
        hits as (select doc_id, count(distinct spot) as n_hit from (select doc_id, unnest(range(p, p + n)) as spot from met) group by 1),
        items as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from met group by 1)
        select d.doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
            coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated from d left join hits using (doc_id) left join items using (doc_id)""",
    "op11_conversation_repair": _repair_sql(),
    "op12_importance_resampling": f"""
        with {_CRC_TABLE},
        d as (select doc_id, regexp_extract_all({_LOWER.format('text')}, '{WORD}') as ws from documents),
        b as (select regexp_extract_all({_LOWER.format('text')}, '{WORD}') as ws from benchmark),
        fd as (select doc_id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) as f from d),
        fb as (select unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) as f from b),
        cd as (select doc_id, f, count(*) as n from fd group by all), cb as (select f, count(*) as n from fb group by all),
        hashed as (select f, {_CRC.format("f")} % 10000 as bucket from (select f from cd union select f from cb), crcs),
        s as (select bucket, sum(n) as n from cd join hashed using (f) group by 1), t as (select bucket, sum(n) as n from cb join hashed using (f) group by 1),
        totals as (select coalesce((select sum(n) from s), 0)::double + 10000 as s_all, coalesce((select sum(n) from t), 0)::double + 10000 as t_all),
        gained as (select bucket, floor(1000 * ln((coalesce(t.n, 0)::double + 1) * s_all / ((s.n::double + 1) * t_all)))::bigint as gain from s left join t using (bucket), totals),
        weighed as (select doc_id, sum(n)::bigint as n_features, floor(sum(n * gain)::double / sum(n))::bigint as weight from cd join hashed using (f) join gained using (bucket) group by 1),
        scored as (select doc_id, len(ws) >= 20 as fit, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('7:' || doc_id::varchar), 8))::bigint + 0.5::double) / 4294967296)))::bigint as score
            from d left join weighed using (doc_id)),
        ranked as (select *, row_number() over (partition by fit order by score desc, doc_id) as r, count(*) over (partition by fit) as n from scored)
        select doc_id, n_features, weight, score, case when fit and r <= 25 * n // 100 then r end as rank from ranked""",
    "op5_exact_dedup": """
        select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = max(doc_id) over w as kept,
               sha256(coalesce(text, '')) as text_sha256
        from documents window w as (partition by coalesce(text, ''))""",
}
