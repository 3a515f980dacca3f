"""Queries over the driver's tables, one or more for each operator, and the SQL that they are held against."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import contracts as K
from ..functions import text as T
from ..functions.jsonx import array_literal, pretty
from ..operators import curate as C
from ..operators import evaluate as E
from ..operators import generate as G
from ..operators import repair as R
from ..operators import views as V
from ..sources.readers import read_jsonl, with_sample_ids
from ..sources.sinks import scratch, write_jsonl
from ..streaming.feeds import flush, smallest_group, stream_jsonl

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- documents as records: validation, de-duplication, scoring, quotas

_KEY = "lang, trim(text, ' ')"
_SCORE = "(case when length(text) >= 500 then 2 else 0 end + case when contains(text, '!') then -1 else 0 end + case when contains(text, '|') then -2 else 0 end + case when contains(text, '#') then -3 else 0 end)::int"


def _score(d: DataFrame) -> DataFrame:
    has = lambda n: F.contains("text", F.lit(n))
    w = lambda c, n: F.when(c, n).otherwise(0)
    return d.withColumn("score", (w(F.length("text") >= 500, 2) - w(has("!"), 1) - w(has("|"), 2) - w(has("#"), 3)).cast("int"))


def _firsts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where(F.trim("text") != "")
    return C.first_by(docs, [F.col("lang"), F.md5(F.trim("text"))], [F.col("doc_id")]).where("nth = 1").drop("nth")


_BASE = f"""d as (select * from documents where trim(text, ' ') <> ''), f as (select * from d qualify row_number() over (partition by {_KEY} order by doc_id) = 1),
s as (select *, {_SCORE} as score from f), c as (select lang, count(*) as n from s group by lang)"""
_QUOTA = """t as (select *, least(90, sum(n) over ()) as goal, sum(n) over () as total from c), e as (select *, (goal * n)::double / total as exact from t),
b as (select *, floor(exact) as base, goal - sum(floor(exact)) over () as spare from e),
q as (select lang, n, (base + case when row_number() over (order by exact - base desc, lang) <= spare then 1 else 0 end)::bigint as quota from b)"""


@query(f"with {_BASE}, {_QUOTA}, r as (select s.*, row_number() over (partition by s.lang order by score desc, n_chars desc, doc_id) as nth from s) select doc_id, r.lang, score, nth::int as nth from r join q using (lang) where nth <= quota")
def curate_topk_quota(spark, d):
    """Validate, keep first copies, score, share 90 places among languages, take the best of each."""
    s = _score(_firsts(spark, d))
    quotas = C.hamilton_quota(s.groupBy("lang").agg(F.count("*").alias("n")), "lang", 90)
    return C.top_by_quota(s, "lang", quotas, [F.desc("score"), F.desc("n_chars"), F.col("doc_id")]).where("selected").select("doc_id", "lang", "score", "nth")


@query(f"with {_BASE}, {_QUOTA} select * from q")
def hamilton_quota(spark, d):
    return C.hamilton_quota(_firsts(spark, d).groupBy("lang").agg(F.count("*").alias("n")), "lang", 90)


@query(f"with {_BASE}, {_QUOTA}, r as (select s.*, row_number() over (partition by s.lang order by score desc, n_chars desc, doc_id) as nth from s) select doc_id, r.lang, case when score < 0 then 'low_score' else 'lower_ranked' end as reason from r join q using (lang) where nth > quota")
def lower_ranked_rejects(spark, d):
    s = _score(_firsts(spark, d))
    quotas = C.hamilton_quota(s.groupBy("lang").agg(F.count("*").alias("n")), "lang", 90)
    out = C.top_by_quota(s, "lang", quotas, [F.desc("score"), F.desc("n_chars"), F.col("doc_id")]).where("not selected")
    return out.select("doc_id", "lang", F.when(F.col("score") < 0, "low_score").otherwise("lower_ranked").alias("reason"))


def _reasons(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    r = C.reasons_array((F.trim("text") == "", "text.blank"), (F.col("n_chars") < 200, "text.short"), (~F.col("lang").isin("en", "de"), "lang.other"), (F.col("quality") == 0, "label.quality"), (F.col("toxic") == 1, "label.toxic"))
    deny = C.deny_reasons(F.col("text"), (("deny.bar", (" | ",)), ("deny.mark", ("!!", "###"))))
    return docs.withColumn("reasons", F.concat(r, deny))


_REASONS = """r as (select doc_id, lang, list_filter([case when trim(text, ' ') = '' then 'text.blank' end, case when n_chars < 200 then 'text.short' end, case when lang not in ('en', 'de') then 'lang.other' end,
case when quality = 0 then 'label.quality' end, case when toxic = 1 then 'label.toxic' end, case when contains(text, ' | ') then 'deny.bar' end, case when contains(text, '!!') or contains(text, '###') then 'deny.mark' end], lambda x: x is not null) as reasons
from documents left join labels using (doc_id))"""


@query(f"with {_REASONS} select doc_id, array_to_string(reasons, ',') as reasons from r")
def validate_reasons(spark, d):
    return _reasons(spark, d).select("doc_id", F.array_join("reasons", ",").alias("reasons"))


@query(f"with {_REASONS} select unnest(reasons) as reason, count(*) as n from r group by 1")
def reject_reason_counts(spark, d):
    return C.reason_counts(_reasons(spark, d))


@query(f"with {_REASONS} select unnest(reasons) as reason, count(*) as n from r group by 1 order by n desc, reason limit 3")
def commonest_reasons(spark, d):
    return C.reason_counts(_reasons(spark, d), 3)


@query(f"with {_REASONS} select lang as grp, count(*) filter (len(reasons) = 0) as n_kept, count(*) filter (len(reasons) > 0) as n_rejected, count(*) as n_rows, grouping(lang)::int as is_total from r group by rollup(lang)")
def keep_reject_by_lang(spark, d):
    return C.keep_counts(_reasons(spark, d), F.col("lang"))


@query(f"with {_REASONS} select doc_id from r where len(reasons) = 0")
def route_kept(spark, d):
    return C.route(_reasons(spark, d))[0].select("doc_id")


@query(f"with {_BASE} select doc_id, lang from f")
def dedup_first(spark, d):
    return _firsts(spark, d).select("doc_id", "lang")


@query("select lang, md5(text) as key, count(*) as n from documents group by lang, text having count(*) > 1")
def dup_key_counts(spark, d):
    docs = table(spark, d, "documents").select("lang", F.md5("text").alias("key"))
    return C.duplicate_keys(docs, ["lang", "key"])


@query("select doc_id, source from documents qualify row_number() over (partition by source order by doc_id) <= 3")
def keep_first_k_per_source(spark, d):
    return C.keep_k(table(spark, d, "documents"), ["source"], ["doc_id"], 3).select("doc_id", "source")


@query("select conv_id, turn, role from conversations qualify row_number() over (partition by conv_id order by turn desc) <= 2")
def keep_last_k_per_conv(spark, d):
    return C.keep_k(table(spark, d, "conversations"), ["conv_id"], ["turn"], 2, last=True).select("conv_id", "turn", "role")


@query(f"select doc_id, {_SCORE} as score from documents")
def score_rules(spark, d):
    return _score(table(spark, d, "documents")).select("doc_id", "score")


@query(f"select {_SCORE} as score, count(*) as n from documents group by 1")
def score_histogram(spark, d):
    return C.histogram(_score(table(spark, d, "documents")))


# ---- text and JSON functions

_W = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_COLLAPSED = rf"regexp_replace(regexp_replace(text, '{_W}+', ' ', 'g'), '^ | $', '', 'g')"


@query(rf"with c as (select doc_id, {_COLLAPSED} as t from documents) select doc_id, md5(t) as clean_md5, length(t)::int as clean_chars from c")
def clean_text(spark, d):
    t = T.collapse(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(t).alias("clean_md5"), F.length(t).alias("clean_chars"))


@query("select doc_id, md5(replace(replace(text, 'the', 'THE'), 'THE of', 'of')) as rewritten_md5 from documents")
def phrase_rewrite(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.rewrite(F.col("text"), (("the", "THE"), ("THE of", "of")))).alias("rewritten_md5"))


@query("select doc_id, md5('用户问题: ' || lang || chr(10) || '环境: ' || source || chr(10) || '命令: ' || chr(10) || '日志:' || chr(10) || text) as flat_md5 from documents")
def flatten_labelled(spark, d):
    task = F.struct(F.col("lang").alias("user_question"), F.col("source").alias("environment"), F.lit(None).cast("string").alias("command"), F.col("text").alias("log"))
    return table(spark, d, "documents").withColumn("input", task).select("doc_id", F.md5(V.labelled_input()).alias("flat_md5"))


@query("select doc_id, md5(lang || chr(10) || source || chr(10) || text || chr(10) || 'a' || chr(10) || 'b') as flat_md5 from documents")
def flatten_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.flatten(F.col("lang"), F.col("source"), F.lit(None).cast("string"), F.col("text"), F.array(F.lit("a"), F.lit("b")))).alias("flat_md5"))


@query("select event_type, count(json_extract(props, '$.k')) as n, sum(json_extract_string(props, '$.k')::bigint)::bigint as k_sum, max(json_extract_string(props, '$.k')::bigint) as k_max from events group by event_type")
def json_field_metrics(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    return table(spark, d, "events").groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k).alias("k_sum"), F.max(k).alias("k_max"))


@query("""select conv_id, turn, md5('{' || chr(10) || '  "role": "' || role || '",' || chr(10) || '  "turns": [' || chr(10) || '    ' || turn || chr(10) || '  ],' || chr(10) || '  "chars": ' || length(text) || chr(10) || '}') as json_md5 from conversations""")
def pretty_json(spark, d):
    s = F.struct("role", F.array("turn").alias("turns"), F.length("text").alias("chars"))
    df = table(spark, d, "conversations").select("conv_id", "turn", s.alias("s"))
    return df.select("conv_id", "turn", F.md5(pretty(F.col("s"), df.schema["s"].dataType)).alias("json_md5"))


# ---- training views, unions, splits

_PAIRS = """p as (select *, lead(role) over w as next_role, lead(text) over w as output, first_value(case when role = 'system' then text end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and unbounded following) as system
from conversations window w as (partition by conv_id order by turn)), t as (select conv_id, turn, text as instruction, output, coalesce(system, '') as system from p where role = 'user' and next_role = 'assistant')"""


@query(f"with {_PAIRS} select * from t")
def sft_from_conversations(spark, d):
    return V.turns_to_pairs(table(spark, d, "conversations"))


@query(f"with {_PAIRS} select conv_id, turn, output, 'Be brief.' as system, 'Answer.' as instruction from t")
def prompt_view_override(spark, d):
    return V.override_prompt(V.turns_to_pairs(table(spark, d, "conversations")), "Be brief.", "Answer.")


@query(f"with {_PAIRS} select conv_id, turn, array_to_string(list_filter([nullif(trim(system, ' '), ''), nullif(trim(instruction, ' '), '')], lambda x: x is not null), chr(10)) as prompt from t")
def build_prompt(spark, d):
    t = V.turns_to_pairs(table(spark, d, "conversations"))
    return t.select("conv_id", "turn", T.prompt(F.col("system"), F.col("instruction")).alias("prompt"))


@query("with x as (select doc_id, 0 as union_idx from documents where lang = 'en' union all select item_id, 1 from benchmark) select union_idx, count(*) as n, min(doc_id) as least from x group by union_idx")
def union_with_handpicked(spark, d):
    a, b = table(spark, d, "documents").where("lang = 'en'").select("doc_id"), table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"))
    return V.union_ordered(a, b).groupBy("union_idx").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))


@query("with n as (select *, row_number() over (order by item_id) as ord from benchmark) select item_id, (p - 1)::bigint as pick from n join (select unnest([3, 1, 7]) as pos, unnest([1, 2, 3]) as p) on ord = pos")
def pick_positions(spark, d):
    b = C.numbered(table(spark, d, "benchmark"), ["item_id"], "ord", 1)
    return V.pick_by_position(b, "ord", (3, 1, 7)).select("item_id", "pick")


@query("select coalesce(nullif(source, ''), 'unknown') as value, count(*) as n from documents group by 1")
def category_distribution(spark, d):
    return C.value_counts(table(spark, d, "documents"), F.col("source"), "unknown")


@query("select count(*) as n_rows, count(distinct source) as n_sources, sum(n_chars)::bigint as n_chars, count(distinct lang) as n_langs from documents")
def dataset_manifest(spark, d):
    return C.manifest(table(spark, d, "documents"), ["source", "lang"], ["n_chars"])


_SPLIT = "s as (select doc_id, case when (((doc_id + 42) * 2654435761) % 1000003) % 1000 < 110 then 'eval' else 'train' end as split from documents)"


@query(f"with {_SPLIT} select * from s")
def split_hash(spark, d):
    return V.hash_split(table(spark, d, "documents"), F.col("doc_id"), 110).select("doc_id", "split")


@query(f"with {_SPLIT} select split, count(*) as n from s group by split")
def split_counts(spark, d):
    return V.hash_split(table(spark, d, "documents"), F.col("doc_id"), 110).groupBy("split").agg(F.count("*").alias("n"))


@query(f"with {_SPLIT} select doc_id from s where split = 'train' order by doc_id limit 32")
def smoke_subset(spark, d):
    return V.hash_split(table(spark, d, "documents"), F.col("doc_id"), 110).where("split = 'train'").orderBy("doc_id").limit(32).select("doc_id")


@query("select event_id, ((row_number() over (partition by user_id order by event_id)) - 1) // 8 as chunk from events")
def chunks_per_user(spark, d):
    return C.chunked(table(spark, d, "events"), ["event_id"], 8, by=["user_id"]).select("event_id", "chunk")


@query("select doc_id, (row_number() over (order by doc_id) - 1) // 32 as chunk from documents")
def chunks_of_all(spark, d):
    return C.chunked(table(spark, d, "documents").select("doc_id"), ["doc_id"], 32)


@query("select doc_id, row_number() over (order by source, lang desc, doc_id) - 1 as place from documents")
def sorted_places(spark, d):
    """A total order over all rows, numbered range by range."""
    return C.numbered(table(spark, d, "documents").select("doc_id", "source", "lang"), [F.col("source"), F.desc("lang"), F.col("doc_id")], "place").select("doc_id", "place")


@query("select sample_id, row_number() over (order by sample_id) as place from (select 'train_' || case when doc_id between 0 and 999 then lpad(doc_id::varchar, 3, '0') else doc_id::varchar end as sample_id from documents)")
def sorted_ids(spark, d):
    """Ids in the order of their text: train_1000 comes before train_999."""
    return C.numbered(with_sample_ids(table(spark, d, "documents").select("doc_id"), "doc_id").select("sample_id"), ["sample_id"], "place", 1)


_SHUFFLED = random.Random(42)
_ORDER = list(range(60))
_SHUFFLED.shuffle(_ORDER)


@query("select * from (values " + ", ".join(f"({o}::bigint, '{'eval' if i < 10 else 'train'}', {10 <= i < 18})" for i, o in enumerate(_ORDER)) + ") v(id, split, smoke)")
def seeded_split(spark, d):
    """What a seeded shuffle of 60 rows gives: eval first, the rest train, smoke the first of train."""
    return V.exact_split(spark.range(60), "id", 60, 10, 8).select("id", "split", "smoke")


@query("select unnest([" + ", ".join(map(str, random.Random(42).sample(range(500), 25))) + "])::bigint as id")
def seeded_sample(spark, d):
    return V.exact_sample(spark.range(500), "id", 500, 25, key="id")


# ---- rule metrics and pairwise judging: documents as model outputs, even and odd ids as sides A and B


def _outputs(spark, d):
    docs = table(spark, d, "documents")
    cat = F.element_at(F.array(F.lit("data"), F.lit("training"), F.lit("other")), (F.col("doc_id") % 3 + 1).cast("int"))
    every = lambda n, yes, no: F.when(F.col("doc_id") % n == 0, yes).otherwise(no)
    raw = F.concat(
        F.lit('{"category": "'), cat, F.lit('", "severity": "high", "summary": "'), every(11, "\\ud800", every(8, "  ", "s")), F.lit('", "root_cause": "'), F.col("source"), F.lit('", "missing_info": ['),
        every(9, "", '"m"'), F.lit('], "next_steps": ["n"]'), every(5, ', "extra": 1', ""), every(13, ', "x": NaN', ""), every(7, "", "}"),
    )
    ref = every(17, F.lit("none"), F.concat(F.lit('{"category": "'), F.element_at(F.array(F.lit("data"), F.lit("training")), (F.col("doc_id") % 2 + 1).cast("int")), F.lit('"}')))
    return docs.select("doc_id", F.col("lang").alias("variant"), raw.alias("raw_output"), ref.alias("ref"), F.length("text").alias("length"))


_M = """m0 as (select doc_id, lang as variant, doc_id % 7 <> 0 as ok, doc_id % 5 = 0 or doc_id % 13 = 0 as extra, ['data', 'training', 'other'][doc_id % 3 + 1] as cat, case when doc_id % 17 <> 0 then ['data', 'training'][doc_id % 2 + 1] end as ref,
case when doc_id % 11 = 0 then '\\ud800' when doc_id % 8 = 0 then '  ' else 's' end as summary, source, doc_id % 9 <> 0 as listed,
'{"category": "' || cat || '", "severity": "high", "summary": "' || summary || '", "root_cause": "' || source || '", "missing_info": [' || case when listed then '"m"' else '' end || '], "next_steps": ["n"]' || case when doc_id % 5 = 0 then ', "extra": 1' else '' end || case when doc_id % 13 = 0 then ', "x": NaN' else '' end as raw from documents),
m as (select *, ok and not extra and cat <> 'other' and trim(summary) <> '' and trim(source) <> '' and listed as valid, case when ok then cat = ref end as same from m0)"""


@query(f"""with {_M} select doc_id, ok as json_parse_success, ok as required_fields_present, ok and not extra as no_extra_top_level_fields, ok and cat <> 'other' as category_enum_valid, ok as severity_enum_valid, ok and trim(summary) <> '' as summary_nonempty,
ok and trim(source) <> '' as root_cause_nonempty, ok and listed as missing_info_is_nonempty_list, ok as next_steps_is_nonempty_list, valid as schema_valid, same as category_matches_reference, case when ok and ref is not null then false end as severity_matches_reference,
case when not ok then 'Expecting '','' delimiter at line 1 column ' || length(raw) + 1 end as parse_error from m""")
def rule_metrics(spark, d):
    """All flags over outputs that are cut short, have more or empty fields, NaN, or half a surrogate pair."""
    return E.rule_metrics(_outputs(spark, d), reference="ref").select("doc_id", "metrics.*")


@query(f"""with {_M}, x as (select variant, unnest(['json_parse_success', 'schema_valid', 'category_matches_reference']) as metric, unnest([ok, valid, same]) as v from m)
select variant, metric, count(*) filter (v) as passed, count(v) as of, case when count(v) > 0 then round_even(count(*) filter (v) / count(v)::double, 4) end as rate from x group by variant, metric""")
def metric_summary(spark, d):
    return E.metric_summary(E.rule_metrics(_outputs(spark, d), reference="ref"), flags=("json_parse_success", "schema_valid"), optional=("category_matches_reference",))


@query(f"with {_M} select variant, string_agg(doc_id::varchar, ',' order by doc_id) as ids from m where not valid group by variant")
def failing_ids(spark, d):
    return E.failing_ids(E.rule_metrics(_outputs(spark, d)), F.col("metrics.schema_valid"), "doc_id", "variant")


@query("select lang, avg(n_chars) as mean, min(n_chars) as least, max(n_chars) as most, count(n_chars) as n from documents where n_chars is not null group by lang")
def length_stats(spark, d):
    return E.number_stats(table(spark, d, "documents"), ["lang"], "n_chars")


@query("select event_type as value, count(*) as n from events where event_type is not null group by 1")
def finish_reason_hist(spark, d):
    return C.value_counts(table(spark, d, "events").where("event_type is not null"), F.col("event_type"))


def _sides(spark, d):
    docs = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 2).cast("long").alias("sample_id"), (F.col("doc_id") % 2).alias("side"), "text", "n_chars", (F.col("n_chars") % 3 > 0).alias("valid"), "lang")
    return E.pair_results(docs.where("side = 0").drop("side"), docs.where("side = 1").drop("side"))


_P = "s as (select doc_id // 2 as sample_id, doc_id % 2 as side, text, n_chars, n_chars % 3 > 0 as valid, lang from documents), p as (select a.sample_id, a.valid as av, b.valid as bv, a.n_chars as an, b.n_chars as bn, a.text as a_text, b.text as b_text, a.lang as al, b.lang as bl from s a join s b on a.sample_id = b.sample_id and a.side = 0 and b.side = 1)"
_J = _P + """, j as (select *, case when av and not bv then 'A' when bv and not av then 'B' when not av and not bv then 'tie' when an > bn + 500 then 'A' when bn > an + 500 then 'B' else 'tie' end as winner,
case when av and bv then case when abs(an - bn) > 2000 then 'high' when abs(an - bn) > 1000 then 'medium' else 'low' end else 'high' end as winner_confidence, (an % 5 + 1)::int as a_score, (bn % 5 + 1)::int as b_score from p)"""


def _judged(spark, d):
    p = _sides(spark, d)
    winner, confidence, source = E.schema_gate(F.col("a.valid"), F.col("b.valid"))
    gap = F.col("a.n_chars") - F.col("b.n_chars")
    own = F.when(gap > 500, "A").when(gap < -500, "B").otherwise("tie")
    sure = F.when(F.abs(gap) > 2000, "high").when(F.abs(gap) > 1000, "medium").otherwise("low")
    score = lambda s: (F.col(f"{s}.n_chars") % 5 + 1).cast("int")
    both = F.struct(score("a").alias("A_score"), score("b").alias("B_score"))
    w = F.coalesce(winner, own)
    return p.select("sample_id", w.alias("winner"), F.coalesce(confidence, sure).alias("winner_confidence"), F.coalesce(source, F.lit("judge")).alias("judge_source"), both.alias("overall_scores"), F.create_map(F.lit("actionability"), both, F.lit("root_cause_quality"), both).alias("dimension_scores"), F.create_map(F.lit("actionability"), w, F.lit("root_cause_quality"), F.lit("tie")).alias("dimension_winners"), F.md5("a.text").alias("candidate_a"), F.md5("b.text").alias("candidate_b"))


@query(f"with {_P} select sample_id, an as a_chars, bn as b_chars from p")
def pair_join(spark, d):
    return _sides(spark, d).select("sample_id", F.col("a.n_chars").alias("a_chars"), F.col("b.n_chars").alias("b_chars"))


@query(f"with {_P} select sample_id, case when av and not bv then 'A' when bv and not av then 'B' when not av and not bv then 'tie' end as winner from p")
def schema_gate(spark, d):
    return _sides(spark, d).select("sample_id", E.schema_gate(F.col("a.valid"), F.col("b.valid"))[0].alias("winner"))


@query(f"with {_J} select count(*) as n, count(*) filter (winner = 'A') as n_a, count(*) filter (winner = 'B') as n_b, count(*) filter (winner = 'tie') as n_tie, count(*) filter (winner <> 'tie') as n_usable, count(*) filter (winner <> 'tie' and winner_confidence = 'high') as n_high, count(*) filter (winner = 'A')::double / count(*) filter (winner <> 'tie') as a_rate, count(*) filter (winner = 'B')::double / count(*) filter (winner <> 'tie') as b_rate from j")
def judge_summary(spark, d):
    return E.judge_summary(_judged(spark, d))


@query(f"""with {_J}, x as (select unnest(['source', 'winner', 'wins']) as kind, unnest([case when av and bv then 'judge' else 'schema_gate' end, winner, case winner when 'A' then 'even' when 'B' then 'odd' else 'tie' end]) as value, 1 as one from j
union all select 'wins', unnest(['even', 'odd', 'tie']), 0) select kind, value, sum(one)::bigint as n from x group by kind, value""")
def judge_breakdown(spark, d):
    return E.judge_counts(_judged(spark, d), "even", "odd")


@query(f"with {_J} select sample_id, winner <> 'tie' as usable_for_dpo, winner <> 'tie' and winner_confidence = 'high' as high_confidence_for_dpo from j")
def judged_flags(spark, d):
    return E.judged_flags(_judged(spark, d)).select("sample_id", "usable_for_dpo", "high_confidence_for_dpo")


@query(f"with {_J} select count(*) filter (winner = 'A')::double / count(*) filter (winner <> 'tie') as a_rate, count(*) filter (winner = 'B')::double / count(*) filter (winner <> 'tie') as b_rate from j")
def win_rate_excl_ties(spark, d):
    return E.judge_summary(_judged(spark, d)).select("a_rate", "b_rate")


@query(f"""with {_J}, x as (select unnest(['actionability', 'root_cause_quality']) as dimension, unnest([winner, 'tie']) as won, a_score, b_score from j)
select dimension, count(*) filter (won = 'A') as n_a, count(*) filter (won = 'B') as n_b, count(*) filter (won = 'tie') as n_tie, sum(a_score)::bigint as a_sum, sum(b_score)::bigint as b_sum, count(*) as n_scored, avg(b_score - a_score) as delta from x group by dimension""")
def dimension_stats(spark, d):
    return E.dimension_stats(_judged(spark, d))


@query(f"""with {_J}, t as (select *, case winner when 'A' then 'B' when 'B' then 'A' else winner end as w from j)
select sample_id, w as winner, b_score as a_score, a_score as b_score, w as own_dimension, 'tie' as tied_dimension, b_score as a_dimension, a_score as b_dimension from t""")
def swapped_back(spark, d):
    t = E.swap_sides(_judged(spark, d), F.lit(True))
    score = lambda s: F.element_at("dimension_scores", F.lit("actionability"))[f"{s}_score"]
    return t.select(
        "sample_id", "winner", F.col("overall_scores.A_score").alias("a_score"), F.col("overall_scores.B_score").alias("b_score"), F.element_at("dimension_winners", F.lit("actionability")).alias("own_dimension"),
        F.element_at("dimension_winners", F.lit("root_cause_quality")).alias("tied_dimension"), score("A").alias("a_dimension"), score("B").alias("b_dimension"),
    )


@query(f"""with {_P} select count(*) as n, count(*) filter (av is not distinct from bv) as same_valid, count(*) filter (al is not distinct from bl) as same_lang, avg(an) as a_elapsed, avg(bn) as b_elapsed, avg(bn - an) as elapsed_delta,
avg(coalesce(case when an % 4 > 0 then an end, 0)) as a_length, avg(coalesce(case when bn % 4 > 0 then bn end, 0)) as b_length from p""")
def backend_compare(spark, d):
    """Side against side: mean lengths count what isn't known as 0."""
    known = lambda s: F.col(s).withField("length", F.when(F.col(f"{s}.n_chars") % 4 > 0, F.col(f"{s}.n_chars")))
    return E.compare_backends(_sides(spark, d).withColumns({"a": known("a"), "b": known("b")}), ["valid", "lang"], "n_chars", "length")


_D = _J + ", d as (select *, sample_id % 40 as prompt_id, case when winner = 'A' then md5(a_text) else md5(b_text) end as chosen, case when winner = 'A' then md5(b_text) else md5(a_text) end as rejected, case when winner = 'A' then a_score - b_score else b_score - a_score end::double as score_delta from j where winner <> 'tie')"


def _pairs(spark, d):
    return E.preference_rows(_judged(spark, d)).withColumn("prompt_id", F.col("sample_id") % 40)


@query(f"with {_D} select sample_id, chosen, rejected, score_delta from d")
def dpo_pairs(spark, d):
    return _pairs(spark, d).select("sample_id", "chosen", "rejected", "score_delta")


def _top(c):
    return f"with {_D} select sample_id, prompt_id from d where winner_confidence in ({c}) qualify row_number() over (partition by prompt_id order by case winner_confidence when 'high' then 2 else 1 end desc, score_delta desc, sample_id) <= 2"


@query(_top("'high'"))
def dpo_high_only(spark, d):
    return E.top_pairs(_pairs(spark, d), 2, ["high"], ["sample_id"], "prompt_id").select("sample_id", "prompt_id")


@query(_top("'high', 'medium'"))
def dpo_high_plus_medium(spark, d):
    return E.top_pairs(_pairs(spark, d), 2, ["high", "medium"], ["sample_id"], "prompt_id").select("sample_id", "prompt_id")


@query(f"with {_D} select d.sample_id, d.chosen, coalesce(b.text, '') as instruction from d left join (select item_id, text from benchmark) b on b.item_id = d.sample_id")
def dpo_restore_prompts(spark, d):
    prompts = table(spark, d, "benchmark").select(F.col("item_id").alias("sample_id"), F.col("text").alias("instruction"))
    return E.restore_prompts(_pairs(spark, d).select("sample_id", "chosen"), prompts, fields=("instruction",))


@query("select * from (select source as grp, count(*)::int as n from documents where source in ('src1', 'src2', 'src3') group by source) order by n, grp limit 1")
def category_balance_argmin(spark, d):
    counts = table(spark, d, "documents").groupBy(F.col("source").alias("grp")).agg(F.count("*").cast("int").alias("n"))
    return smallest_group(counts, "grp", ["src1", "src2", "src3"])


@query("select source, lang, count(*) as n, grouping(source)::int as all_sources, grouping(lang)::int as all_langs from documents group by rollup(source, lang)")
def source_lang_rollup(spark, d):
    return C.field_counts(table(spark, d, "documents"), "source", "lang").withColumnsRenamed({"all_source": "all_sources", "all_lang": "all_langs"})


@query("select v.variant, count(*) as n from benchmark cross join (select unnest(['base', 'tuned']) as variant) v group by v.variant")
def variants_by_rows(spark, d):
    return G.cross_variants(table(spark, d, "benchmark"), [{"variant": "base"}, {"variant": "tuned"}]).groupBy("variant").agg(F.count("*").alias("n"))


# ---- diagnosis records made from documents: the task's own scores, selection and repair


def _pick(values, n=None):
    """The value at doc_id modulo n, '' beyond the last: what makes the Column, and the SQL."""
    values = [*values, *[""] * ((n or len(values)) - len(values))]
    sql = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return lambda: F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % len(values) + 1).cast("int")), f"[{sql}][doc_id % {len(values)} + 1]"


_FIELDS = {"question": _pick(K.GOOD_SIGNALS, 29), "log": _pick(("OOM", "404", "RuntimeError", "fine", "out of memory")), "category": _pick((*K.CATEGORIES, "odd")), "severity": _pick(K.SEVERITIES), "summary": _pick(K.BAD_ADVICE, 23), "generic": _pick(K.GENERIC_ROOTS, 17), "weak": _pick(K.WEAK_STEPS, 19)}
_MADE = "made as (select doc_id, " + ", ".join(f"{sql} as {k}" for k, (_, sql) in _FIELDS.items()) + ", repeat('x', (doc_id % 50)::int) || generic as root, case when doc_id % 2 = 0 then [weak, 'y'] else [weak] end as steps, case when doc_id % 4 < 2 then ['a', 'b'] else ['a'] end as missing from documents)"


def _made(spark, d):
    f = {k: make() for k, (make, _) in _FIELDS.items()}
    i, lit = F.col("doc_id"), F.lit
    steps, missing = F.when(i % 2 == 0, F.array(f["weak"], lit("y"))).otherwise(F.array(f["weak"])), F.when(i % 4 < 2, F.array(lit("a"), lit("b"))).otherwise(F.array(lit("a")))
    root = F.concat(F.repeat(lit("x"), (i % 50).cast("int")), f["generic"])
    record = F.struct(f["category"].alias("category"), f["severity"].alias("severity"), f["summary"].alias("summary"), root.alias("root_cause"), missing.alias("missing_info"), steps.alias("next_steps"))
    return table(spark, d, "documents").select("doc_id", lit(K.INSTRUCTION).alias("instruction"), F.struct(f["question"].alias("user_question"), lit("e").alias("environment"), lit("c").alias("command"), f["log"].alias("log")).alias("input"), record.alias("output"))


def _any(c, needles):
    return "(" + " or ".join(f"contains({c}, '{n}')" for n in needles) + ")"


def _found(c, needles):
    return "(" + " + ".join(f"contains({c}, '{n}')::int" for n in needles) + ")"


_ALL = "concat_ws('|', question, log, category, severity, summary, root, array_to_string(steps, '|'), 'a', 'b')"
_SCORED = f"""{_MADE}, flags as (select *, {_any(_ALL, K.GOOD_SIGNALS)} as good, {_any('root', K.GENERIC_ROOTS)} as gen, {_found("array_to_string(steps, '|')", K.WEAK_STEPS)} as n_weak, {_found(_ALL, K.BAD_ADVICE)} as n_bad,
{_any('log', ('OOM', 'out of memory'))} as oom, {_any('log', ('404', '403', 'No such file or directory'))} as conc, {_any('log', ('Traceback', 'RuntimeError', 'ValueError'))} as trace from made),
scored as (select *, ((length(root) >= 28)::int + (len(steps) >= 2)::int + (len(missing) >= 2)::int + 2 * good::int - 2 * gen::int - n_weak - 3 * n_bad - (severity = 'low')::int + oom::int + conc::int + trace::int)::int as score,
list_sort(list_filter([case when good then 'specific_signal' end, case when gen then 'generic_root' end, case when n_weak > 0 then 'weak_steps' end, case when n_bad > 0 then 'questionable_advice' end,
case when severity = 'low' then 'low_severity' end, case when oom then 'clear_log_signal' end, case when conc then 'concrete_error' end], lambda x: x is not null)) as why from flags)"""


@query(f"with {_SCORED} select doc_id, score, array_to_string(why, ',') as why from scored")
def diagnosis_scores(spark, d):
    score, why = C.quality_score()
    return _made(spark, d).select("doc_id", score.alias("score"), F.array_join(why, ",").alias("why"))


_PLACE = "list_position([" + ", ".join(f"'{c}'" for c in K.CATEGORIES) + "], category)"


@query(f"""with {_SCORED}, c as (select category, {_PLACE} as place, count(*) as n from scored where category <> 'odd' group by category), t as (select *, sum(n) over () as total, least(90, sum(n) over ()) as goal from c),
e as (select *, (goal * n)::double / total as exact from t), q as (select category, floor(exact) + case when row_number() over (order by exact - floor(exact) desc, place) <= goal - sum(floor(exact)) over () then 1 else 0 end as quota from e),
r as (select *, row_number() over (partition by category order by score desc, len(steps) desc, len(missing) desc, length(root) desc, doc_id) as nth from scored), s as (select r.*, coalesce(nth <= quota, false) as selected from r left join q using (category))
select doc_id, selected, case when selected then null when category = 'odd' then 'unknown_category' when len(why) = 0 then 'lower_ranked' else array_to_string(why, ',') end as reject_reasons from s""")
def selected_records(spark, d):
    return C.select_records(_made(spark, d), 90, ["doc_id"]).select("doc_id", "selected", F.array_join("reject_reasons", ",").alias("reject_reasons"))


def _case(by: dict, oom="oom"):
    text = lambda v: "'" + "|".join(v if isinstance(v, tuple) else (v,)) + "'"
    return f"case when category = 'training' and {oom} then {text(by.get('training/oom', by['training']))} " + " ".join(f"when category = '{c}' then {text(by[c])}" for c in K.CATEGORIES) + " end"


_RAW = _pick((*K.CATEGORY_MAP, "odd"))
_MAPPED = "coalesce(case " + _RAW[1] + " " + " ".join(f"when '{a}' then '{b}'" for a, b in K.CATEGORY_MAP.items()) + " end, 'training')"
_VERSIONLESS = "'" + "|".join(K.MISSING_INFO["dependency/no version"]) + "'"


@query(f"""with r as (select doc_id, {_MAPPED} as category, doc_id % 4 = 0 as oom, doc_id % 3 = 0 as version, doc_id % 5 < 2 as bare from documents)
select doc_id, category, case when bare then 'medium' else 'high' end as severity, case when bare then {_case(K.SUMMARIES)} else '这是 问题。' end as summary, case when bare then {_case(K.ROOT_CAUSES)} else 'r!' end as root_cause,
case when not bare then 'm。' when category = 'dependency' and not version then {_VERSIONLESS} else {_case(K.MISSING_INFO)} end as missing_info, case when bare then {_case(K.NEXT_STEPS)} else 'n.' end as next_steps from r""")
def repaired_records(spark, d):
    i, lit = F.col("doc_id"), F.lit
    given = lambda x: F.when(i % 5 >= 2, x)
    record = F.struct(_RAW[0]().alias("category"), given(lit(" HIGH")).alias("severity"), given(lit("这是  灾难")).alias("summary"), given(lit("r!")).alias("root_cause"), given(F.array(lit("m"), lit("m "))).alias("missing_info"), given(F.array(lit("n."), lit(""))).alias("next_steps"))
    task = F.struct(lit("q").alias("user_question"), F.when(i % 3 == 0, "Version 1").otherwise("none").alias("environment"), lit("c").alias("command"), F.when(i % 4 == 0, "CUDA OOM").otherwise("x").alias("log"))
    out = R.clean_record(table(spark, d, "documents").select("doc_id", lit("").alias("instruction"), task.alias("input"), record.alias("output")))
    return out.select("doc_id", *[F.col(f"output.{k}") for k in ("category", "severity", "summary", "root_cause")], *[F.array_join(f"output.{k}", "|").alias(k) for k in ("missing_info", "next_steps")])


@query("select doc_id, coalesce(lang, '') || '\"' as lang, coalesce(source, '') as items from documents")
def block_fields(spark, d):
    """Values on lines of malformed blocks."""
    block = F.concat(F.lit('  "lang" : "x"\n  "lang": "'), F.coalesce("lang", F.lit("")), F.lit('\\"",\n  "source": ["'), F.coalesce("source", F.lit("")), F.lit('", " "]'))
    t = table(spark, d, "documents").select("doc_id", block.alias("t"))
    return t.select("doc_id", T.unquote(T.field_line(F.col("t"), "lang")).alias("lang"), F.array_join(array_literal(T.field_line(F.col("t"), "source")), "|").alias("items"))


@query(f"with {_J} select avg(a_score) as a_mean, avg(b_score) as b_mean, avg(b_score - a_score) as delta, count(*) as n_scored from j")
def overall_stats(spark, d):
    return E.overall_stats(_judged(spark, d))


@query(f"with {_P} select sample_id, md5(concat_ws(chr(10), 'Sample ID: ' || sample_id, 'System prompt: ' || case when al = 'en' then 'be brief' else '(none)' end, 'Task input:', al, '', 'Candidate A (a):', coalesce(a_text, ''), '', 'Candidate B (b):', coalesce(b_text, ''))) as prompt_md5 from p")
def judge_prompts(spark, d):
    t = _sides(spark, d).select(F.col("sample_id").cast("string").alias("sample_id"), F.col("sample_id").alias("n"), F.when(F.col("a.lang") == "en", "be brief").otherwise("").alias("system"), F.col("a.lang").alias("prompt"), F.lit("a").alias("a_label"), F.col("a.text").alias("a_output"), F.lit("b").alias("b_label"), F.col("b.text").alias("b_output"))
    return t.select(F.col("n").alias("sample_id"), F.md5(E.judge_prompt()).alias("prompt_md5"))


# ---- keys, lookups, and what is written and read back


@query("select source, max(doc_id) as doc_id from documents group by source")
def keyed_last_wins(spark, d):
    return E.last_by_key(table(spark, d, "documents").select("source", "doc_id"), "source", ["doc_id"])


@query("select doc_id, 'train_' || case when doc_id between 0 and 999 then lpad(doc_id::varchar, 3, '0') else doc_id::varchar end as sample_id from documents")
def default_sample_ids(spark, d):
    return with_sample_ids(table(spark, d, "documents").select("doc_id"), "doc_id")


@query("select doc_id from documents where doc_id in (select doc_id from labels)")
def key_intersection(spark, d):
    return C.shared_keys(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query("select doc_id, quality, n_chars from labels join documents using (doc_id)")
def required_lookup(spark, d):
    """A lookup that fails where a label has no document."""
    pairs = E.pair_results(table(spark, d, "labels").select("doc_id", "quality"), table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id", required=True)
    return pairs.select("doc_id", "a.quality", "b.n_chars")


def _written(spark, d) -> str:
    path = scratch(spark, "rows")
    write_jsonl(table(spark, d, "documents").select("doc_id", "lang", F.md5("text").alias("text_md5")), path)
    return path


_ROWS = "doc_id long, lang string, text_md5 string"


@query("select doc_id, lang, md5(text) as text_md5 from documents")
def jsonl_round_trip(spark, d):
    return read_jsonl(spark, _written(spark, d), _ROWS)


@query("select lang, count(*) as n from documents group by lang")
def stream_flush_counts(spark, d):
    """A folder of JSON lines as a stream, flushed to Parquet once, and counted."""
    out = scratch(spark, "flushed")
    flush(stream_jsonl(spark, _written(spark, d), _ROWS), out, scratch(spark, "progress")).awaitTermination()
    return spark.read.parquet(out).groupBy("lang").agg(F.count("*").alias("n"))
