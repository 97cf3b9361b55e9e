"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def op1_size_balanced_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidepanel.llm.sharding import shard_by_size

    return shard_by_size(spark.read.parquet(f"{sf_dir}/documents.parquet"), 40)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidepanel.llm.ngram_join import jaccard_components

    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each stretch of a document that leaks a benchmark item."""
    from tidepanel.llm.decontaminate import find_leaks

    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidepanel.llm.line_dedup import line_dedup

    done = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", F.col("n_tokens").alias("n_lines"), "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op5_warc_range_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidepanel.llm.store import fresh_path
    from tidepanel.llm.warc import read_records, write_archives

    index = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), fresh_path(spark, "warc"))
    page = F.when(F.col("page_key") != "", F.col("page_key").cast("long"))
    return read_records(index, payload=False).select(page.alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidepanel.llm.chat import format_conversations, read_loss_text, read_turns

    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    says = F.lit("\\### Assistant: </turn> ok")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), says.alias("text"))
    done = format_conversations(rows.unionByName(extra))
    done = done.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss_text(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidepanel.llm.pieces import encode

    done = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), decode=True)
    return done.select("doc_id", "n_pieces", F.sha2(F.col("ids"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidepanel.llm.substring_dedup import substring_dedup

    done = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", F.col("n_tokens").alias("n_words"), "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidepanel.llm.quality import quality_rules, train

    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    done = quality_rules(docs.select("doc_id", "text"), train(docs, labels))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def quality_base_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and base rules of op9 alone, which SQL can say."""
    from tidepanel.llm.quality import quality_rules

    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), None).drop("text", "probability")


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidepanel.llm.pii import detect

    done = detect(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    told = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return done.select("doc_id", n("email"), n("ip"), n("card"), n("phone"), F.sha2(told("base").cast("binary"), 256).alias("base_sha256"), told("spans").alias("spans"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidepanel.llm.alignment import align

    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op12_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidepanel.llm.lexical import search, write_index
    from tidepanel.llm.store import fresh_path

    index = write_index(spark.read.parquet(f"{sf_dir}/documents.parquet"), fresh_path(spark, "postings"))
    return search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 10)


def op13_fair_queueing_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidepanel.llm.mixing import mix

    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "source", "times", "first_place")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_size_balanced_sharding, op2_ngram_jaccard_join, op3_benchmark_decontamination, op4_line_dedup, op5_warc_range_reads, op6_chat_formatting, op7_piece_sampling, op8_substring_dedup, op9_quality_rules, op10_personal_data, op11_tokenizer_alignment, op12_ranked_lexical_search, op13_fair_queueing_mix, pipeline, quality_base_rules)}


_LINES = """
with d as (select doc_id, text from documents where text is not null),
l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from d),
w as (select doc_id, pos, line, lead(line, 1) over o as b, lead(line, 2) over o as c, count(*) over (partition by doc_id) as n
      from l window o as (partition by doc_id order by pos)),
f as (select doc_id, pos, row_number() over (partition by line, b, c order by doc_id, pos) as k from w
      where pos + 2 <= n and regexp_matches(line || b || c, '[^\\x20\\x09-\\x0D]')),
gone as (select distinct doc_id, unnest([pos, pos + 1, pos + 2]) as pos from f where k > 1),
kept as (select l.doc_id, l.pos, l.line, g.pos is not null as gone from l left join gone g on l.doc_id = g.doc_id and l.pos = g.pos)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_removed,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from kept group by doc_id
union all select doc_id, 0, 0, sha256('') from documents where text is null
"""

_SUBSTRING = """
with l as (select doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as ws from documents where text is not null),
w as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as pos, len(ws) as n from l),
x as (select doc_id, pos, n, string_agg(word, ' ') over (partition by doc_id order by pos rows between current row and 12 following) as win from w),
f as (select doc_id, pos, doc_id > min(doc_id) over (partition by win) as covered from x where pos + 12 <= n),
s as (select w.doc_id, w.pos, w.word, coalesce(bool_or(f.covered) over (partition by w.doc_id order by w.pos rows between 12 preceding and current row), false) as gone
      from w left join f on w.doc_id = f.doc_id and w.pos = f.pos)
select doc_id, count(*) as n_words, count(*) filter (where gone) as n_removed,
       sha256(coalesce(string_agg(word, ' ' order by pos) filter (where not gone), '')) as kept_sha256
from s group by doc_id
union all select doc_id, 0, 0, sha256('') from l where len(ws) = 0
union all select doc_id, 0, 0, sha256('') from documents where text is null
"""


_CHAT = """
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all select -7, 0, 'user', '\\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
e as (select *, replace(replace(replace(role, '\\', '\\s'), '<', '\\l'), '|', '\\p') as r, replace(replace(text, '\\', '\\s'), '<', '\\l') as t,
             lag(role) over o is distinct from role as head from c window o as (partition by conv_id order by turn, role, text))
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       sum(length(t) + case when head then 7 + length(r) + 3 + 8 else 8 end)::bigint as formatted_chars
from e group by conv_id
"""


_JACCARD = """
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as ws from documents),
s as (select doc_id, list_sort(case when len(ws) >= 5 then list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))
                                    when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as sh from d),
c as (select min(doc_id) as c, sh, len(sh) as n from s where len(sh) > 0 group by sh),
u as (select c, n, unnest(sh) as g from c),
p as (select a.c as x, b.c as y from u a join u b on a.g = b.g and a.c < b.c group by a.c, b.c, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
e as (select x, y from p union all select y, x from p),
r as (select x as c, x as root from e union select e.y, r.root from r join e on r.c = e.x),
k as (select c, min(root) as root from r group by c)
select s.doc_id, len(s.sh) as n_shingles, coalesce(k.root, c.c, s.doc_id) as component_id from s left join c on s.sh = c.sh left join k on k.c = c.c
"""


# equal scores of equal ids have equal rows; logarithms in doubles as asked
_LEXICAL = """
with w as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as ts from documents where text is not null),
d as (select row_number() over () as r, doc_id, len(ts)::bigint as n, ts from w where len(ts) > 0),
s as (select count(*)::bigint as n_docs, sum(n)::bigint as total from d),
p as (select r, doc_id, n, term, count(*)::bigint as tf from (select r, doc_id, n, unnest(ts) as term from d) group by all),
i as (select item_id, term, count(*)::bigint as k from (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from benchmark) group by all),
f as (select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w from p, s where term in (select term from i) group by term, n_docs),
m as (select i.item_id, p.r, p.doc_id, sum(i.k * f.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (25 + (75 * p.n * s.n_docs) // s.total))))::bigint as score
      from i join f using (term) join p using (term), s group by all),
o as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id) as rank from m where score > 0)
select item_id, rank::int as rank, doc_id, score from o where rank <= 10
"""


_QUALITY = """
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
w as (select r, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as ws from d),
x as (select r, unnest(ws) as word, generate_subscripts(ws, 1) as pos, len(ws) as n from w),
t as (select r, pos, n, word || ' ' || lead(word, 1) over o || ' ' || lead(word, 2) over o as win from x window o as (partition by r order by pos)),
f as (select r, pos, count(*) over (partition by r, win) > 1 as twice from t where pos + 2 <= n),
c as (select r, count(*) as n_repeat_words from (select distinct r, unnest([pos, pos + 1, pos + 2]) as pos from f where twice) group by r),
l as (select r, count(*) - count(distinct line) as n_dup_lines from (select r, unnest(string_split(text, chr(10))) as line from d) where regexp_matches(line, '[^\\x20\\x09-\\x0D]') group by r),
k as (select w.doc_id, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
             coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words from w left join c using (r) left join l using (r))
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as kept from k
"""


def oracle_sql() -> dict[str, str]:
    return {"quality_base_rules": _QUALITY, "op2_ngram_jaccard_join": _JACCARD, "op6_chat_formatting": _CHAT, "op4_line_dedup": _LINES, "op8_substring_dedup": _SUBSTRING, "op12_ranked_lexical_search": _LEXICAL}
