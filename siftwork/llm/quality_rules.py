"""Quality rules that vote, weighed by expectation-maximisation; DataFrame and SQL functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import quoted, saved


@dataclass(frozen=True)
class Rule:
    """Votes 1 (good) where good holds, -1 (bad) where bad holds, else 0: it abstains. SQL conditions over the columns of text_statistics."""

    name: str
    good: str
    bad: str


#: Defects vote against and abstain elsewhere; the two votes for good need several signs together, so that a text with one
#: plain defect isn't outvoted by all the defects that it doesn't have.
RULES = (
    Rule("symbols", "false", "5 * n_symbols > n_words"),
    Rule("word_repeats", "false", "10 * n_repeat_words > 4 * n_words"),
    Rule("line_repeats", "false", "10 * n_dup_lines > 3 * n_lines"),
    Rule("shouting", "false", "10 * n_capitals > 4 * word_chars or 5 * n_exclamations > n_words"),
    Rule("odd_words", "false", "word_chars < 2 * n_words or word_chars > 14 * n_words"),
    Rule("prose", "n_words >= 50 and 50 * n_symbols <= n_words and 10 * n_repeat_words <= n_words and 10 * n_capitals <= word_chars and word_chars between 3 * n_words and 10 * n_words", "n_words = 0"),
    Rule("varied", "n_words > 0 and 10 * n_repeat_words <= 4 * n_words and 10 * n_symbols <= n_words and 4 * n_capitals <= word_chars", "false"),
)


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_capitals, n_exclamations) of each row; null text: no words.

    The id column is called id; other columns are not read. Words that lie in a window of three words found twice or more in the
    text are found by sorting the windows' hashes with their places in the low bits; of neighbours the 64-bit hashes of the words
    themselves are compared, so two windows count as equal if all three hashes are.
    A row is worked on alone, so there is no shuffle, and time and memory follow its length.
    """
    t = docs.select(quoted(id_col).alias("id"), F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("t"))
    t = t.select(
        "id", "t", F.expr(r"transform(filter(split(t, '[\\x20\\x09-\\x0D]+'), x -> x <> ''), x -> xxhash64(x))").alias("h"),
        F.expr(r"filter(split(t, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')").alias("ls"),
    )
    t = t.select(
        "id", "h", F.size("h").cast("long").alias("n_words"),
        (F.length("t") - F.regexp_count("t", F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("ls").cast("long").alias("n_lines"), (F.size("ls") - F.size(F.array_distinct("ls"))).cast("long").alias("n_dup_lines"),
        F.regexp_count("t", F.lit("[A-Z]")).cast("long").alias("n_capitals"), F.regexp_count("t", F.lit("!")).cast("long").alias("n_exclamations"),
        F.expr("shiftleft(1L, cast(ceil(log2(size(h) + 1)) as int)) - 1").alias("low"),
    )
    stats = ["id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines"]
    more = ["n_capitals", "n_exclamations"]
    # a key is a window's hash with its place in the low bits
    t = t.select(*stats, *more, "h", "low", F.expr("sort_array(filter(transform(h, (x, i) -> if(i < n_words - 2, (xxhash64(x, get(h, i + 1), get(h, i + 2)) & ~low) | i, null)), x -> x is not null))").alias("s"))
    same = "((get(s, {0}) ^ x) & ~low) = 0 and get(h, cast(get(s, {0}) & low as int)) = get(h, cast(x & low as int)) and get(h, cast(get(s, {0}) & low as int) + 1) = get(h, cast(x & low as int) + 1) and get(h, cast(get(s, {0}) & low as int) + 2) = get(h, cast(x & low as int) + 2)"
    before, after = same.format("j - 1"), same.format("j + 1")
    t = t.select(*stats, *more, F.expr(f"sort_array(transform(filter(s, (x, j) -> coalesce({before}, false) or coalesce({after}, false)), x -> x & low))").alias("f"))
    return t.select(*stats, F.expr("aggregate(transform(f, (x, j) -> least(3L, coalesce(get(f, j + 1) - x, 3L))), 0L, (a, x) -> a + x)").alias("n_repeat_words"), *more)


def vote_patterns(stats: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """stats with votes: the rules' votes, an array of -1, 0 and 1. A condition that is null doesn't hold."""
    votes = [F.expr(f"cast(case when {r.bad} then -1 when {r.good} then 1 else 0 end as int)") for r in rules]
    return stats.withColumn("votes", F.array(*votes))


def estimate_posteriors(voted: DataFrame, rounds: int = 40, balance: float = 0.5, start: float = 0.9, smooth: float = 1.0) -> DataFrame:
    """(votes, n, posterior): the probability of good quality for each pattern of votes that occurs.

    A rule that votes is right with its accuracy, whatever the others vote; abstaining says nothing. Expectation-maximisation
    starts with all accuracies at start; in each round the posterior of every pattern follows from the accuracies and balance
    (the fixed share of good texts, so that the common class doesn't outweigh a lone vote), and a rule's accuracy is then the
    mean posterior of what it voted for, with smooth votes of accuracy start added, between 0.05 and 0.999.
    All documents are counted, by pattern, of which there are 3^rules at most; the rounds are one fold over the array of
    patterns in their order. No rows give no rows.
    """
    pats = voted.groupBy("votes").agg(F.count("*").alias("n")).groupBy().agg(F.array_sort(F.collect_list(F.struct("votes", "n"))).alias("k"))
    pats = pats.where("size(k) > 0")
    ids = "sequence(0, size(k[0].votes) - 1)"
    odds = f"ln({float(balance)}D / (1 - {float(balance)}D))"
    posterior = f"1 / (1 + exp(-({odds} + aggregate({ids}, 0D, (s, r) -> s + x.votes[r] * ln(acc[r] / (1 - acc[r]))))))"
    right = f"aggregate(zip_with(k, q, (x, p) -> case x.votes[r] when 1 then x.n * p when -1 then x.n * (1 - p) else 0D end), {smooth * start}D, (s, x) -> s + x)"
    cast = f"aggregate(k, {float(smooth)}D, (s, x) -> s + x.n * abs(x.votes[r]))"
    step = f"transform(array(transform(k, x -> {posterior})), q -> transform({ids}, r -> greatest(0.05D, least(0.999D, {right} / {cast}))))[0]"
    done = pats.select("k", F.expr(f"aggregate(sequence(1, {int(rounds)}), transform(k[0].votes, v -> {float(start)}D), (acc, i) -> {step})").alias("acc"))
    done = done.select(F.expr(f"transform(k, x -> struct(x.votes as votes, x.n as n, {posterior} as posterior))").alias("z"))
    return done.select(F.explode("z").alias("z")).select("z.votes", "z.n", "z.posterior")


def weigh_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, rounds: int = 40) -> DataFrame:
    """text_statistics of docs with votes and posterior, a row for each row of docs.

    The statistics are written to the shared folder once; patterns are counted from there with partial sums and joined back by
    a broadcast of 3^rules rows at most. Empty texts get votes as any other; equal rows get equal results.
    """
    if len(rules) > 8:
        raise ValueError("more than 8 rules: 3^rules patterns wouldn't be small")
    voted = vote_patterns(saved(text_statistics(docs, id_col, text_col), "rules"), rules)
    return voted.join(F.broadcast(estimate_posteriors(voted, rounds).drop("n")), "votes")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """weigh_rules over all documents; what fails the base is never kept, else the posterior (to six places) decides. Null text has no words and fails."""
    out = weigh_rules(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    return out.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("posterior") >= 0.5)).alias("kept"), F.round("posterior", 6).alias("posterior"))


_VOTES = ", ".join(f"case when {r.bad} then -1 when {r.good} then 1 else 0 end" for r in RULES)
_N = len(RULES)
OP9_SQL = rf"""
with recursive d as (select doc_id, coalesce(text, '') as t from documents),
w as (select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
g as (select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as tri from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from w)),
r as (select doc_id, i from g qualify count(*) over (partition by doc_id, tri) > 1),
f as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from r) group by doc_id),
s as (select w.doc_id, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, len(ls)::bigint as n_lines, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
  coalesce(f.n, 0)::bigint as n_repeat_words, length(regexp_replace(t, '[^A-Z]', '', 'g')) as n_capitals, length(regexp_replace(t, '[^!]', '', 'g')) as n_exclamations from w left join f using (doc_id)),
v as materialized (select *, [{_VOTES}] as votes from s),
k as materialized (select list(struct_pack(v := votes, n := n) order by votes) as k from (select votes, count(*) as n from v group by votes)),
e as (select 0 as i, [{", ".join(["0.9::double"] * _N)}] as acc union all
  select i + 1, list_transform(range(1, {_N + 1}), lambda r: greatest(0.05, least(0.999, (0.9 + list_sum(list_transform(range(1, len(k) + 1), lambda j: case k[j].v[r] when 1 then k[j].n * q[j] when -1 then k[j].n * (1 - q[j]) else 0 end)))
    / (1 + list_sum(list_transform(k, lambda x: x.n * abs(x.v[r]))))))) from (select i, acc, k, list_transform(k, lambda x: 1 / (1 + exp(-list_sum(list_transform(range(1, {_N + 1}), lambda m: x.v[m] * ln(acc[m] / (1 - acc[m]))))))) as q from e, k) where i < 40),
p as (select x.v as votes, 1 / (1 + exp(-list_sum(list_transform(range(1, {_N + 1}), lambda m: x.v[m] * ln(acc[m] / (1 - acc[m])))))) as posterior from (select acc, unnest(k) as x from e, k where i = 40))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and posterior >= 0.5 as kept, round(posterior, 6) as posterior from v join p using (votes)
"""
