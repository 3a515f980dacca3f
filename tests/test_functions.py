"""Functions and operators on small literal frames."""

import json

import pytest
from pyspark.sql import functions as F

from siftwork import contracts as K
from siftwork.functions import text as T
from siftwork.functions.jsonx import array_literal, parse_strict, pretty, strict_json
from siftwork.operators import curate as C
from siftwork.operators import evaluate as E
from siftwork.operators import generate as G
from siftwork.operators import repair as R
from siftwork.operators import views as V
from siftwork.sources import readers, sinks
from siftwork.streaming import feeds


def record(category="training", severity="high", question="q", log="RuntimeError", root="a" * 30, missing=("m1", "m2"), steps=("s1", "s2"), instruction=K.INSTRUCTION):
    return (instruction, (question, "env", "cmd", log), (category, severity, "sum", root, list(missing) if missing is not None else None, list(steps)))


def frame(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"src_line int, {K.RECORD_DDL}")


def one(spark, c, *values, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(c).collect()]


def test_text(spark):
    x = F.col("x")
    assert one(spark, T.strip(x), "　 a\xa0b \x1c\n", "") == ["a\xa0b", ""]
    assert one(spark, T.collapse(x), " a \r\n\t b　c ") == ["a b c"]
    assert one(spark, T.tidy(x), "这是灾难，，真的", "done!", None, "暴力改写") == ["这是问题，真的。", "done!", "", "直接改写。"]
    assert one(spark, T.tidy_list(x), ["a", " ", "a", "无需附加追踪。", "b."], None, kind="array<string>") == [["a。", "b."], []]
    assert one(spark, T.unquote(x), '"a \\"b\\" \\\\"') == ['a "b" \\']
    assert one(spark, T.field_line(x, "k"), '  "k": "v" ,\n "z": 1', "none") == ['"v"', ""]
    assert one(spark, array_literal(x), '["a", " ", "b "]', "broken[") == [["a", "b"], []]
    assert one(spark, T.ordinal_id("eval", x), 7, 1000, kind="int") == ["eval_007", "eval_1000"]


@pytest.mark.parametrize("text,ok", [('{"a":1}', True), ('{"a":1} x', False), ("{'a':1}", False), ('{"a":NaN}', True), ('{"a":1,"a":2}', True), ("[1]", False), ("null", False), ("```json\n{}\n```", False), ('{"a":1,}', False), ('　{"a":"x"}', True), (None, False), ('{"a":"\t"}', False)])
def test_strict_json(text, ok):
    assert parse_strict(text)[0] is ok


def test_json_messages_and_printing(spark):
    assert parse_strict('{"a": }')[1] == "Expecting value at line 1 column 7" and parse_strict("[]")[1] == "Top-level JSON is list, expected object"
    got = one(spark, strict_json(F.col("x")), '{"a": "s", "b": [1, 2], "c": {}}')[0]
    assert got["ok"] and got["scalars"] == {"a": "s"} and got["sizes"] == {"b": 2} and got["kinds"] == {"a": "str", "b": "list", "c": "dict"}
    df = frame(spark, record(root='中"文\\\n', missing=()))
    text = df.select(pretty(F.col("output"), df.schema["output"].dataType)).first()[0]
    assert text == json.dumps(df.first()["output"].asDict(), ensure_ascii=False, indent=2)


def test_validation_and_dedup(spark):
    bad_list = record(steps=("ok", " "))
    rows = [record(), record(question=" q "), record(instruction="x"), (K.INSTRUCTION, None, record()[2]), (K.INSTRUCTION, record()[1], None), record(category="none"), record(severity=None), bad_list, record(missing=None), record(root="pip install qwen-vl", question="other"), record(question="　", log="l")]
    out = {r["src_line"]: r["reasons"] for r in C.validate_and_dedup(frame(spark, *rows), ["src_line"]).collect()}
    assert out[0] == [] and out[1] == ["duplicate.question_log"] and out[2] == ["schema.instruction"] and out[3] == ["schema.input"] and out[4] == ["schema.output"]
    assert out[5] == ["schema.output.category"] and out[6] == ["schema.output.severity"] and out[7] == ["schema.output.next_steps"] and out[8] == ["schema.output.missing_info"]
    assert out[9] == ["bad_package.qwen_vl"] and out[10] == ["schema.input.user_question"]
    late = C.validate_and_dedup(frame(spark, record(instruction="x"), record()), ["src_line"])
    assert [len(r["reasons"]) for r in late.orderBy("src_line").collect()] == [1, 0]
    kept, rejected = C.route(late)
    assert kept.count() + rejected.count() == 2


def test_scores_and_selection(spark):
    rows = [record(root="版本不兼容", steps=("检查文档", "检查文档 again", "x"), severity="low", log="oom 404"), record(root="LD_LIBRARY_PATH " + "a" * 30, log="CUDA OOM"), record(category="data"), record(category="odd")]
    score, why = C.quality_score()
    got = [(r[0], r[1]) for r in frame(spark, *rows).orderBy("src_line").select(score, why).collect()]
    assert got[0] == (1 + 1 - 2 - 1 - 1 + 1, ["concrete_error", "generic_root", "low_severity", "weak_steps"])
    assert got[1] == (1 + 1 + 1 + 2 + 1, ["clear_log_signal", "specific_signal"]) and got[2] == (4, [])
    sel = {r["src_line"]: (r["selected"], r["reject_reasons"]) for r in C.select_records(frame(spark, *rows), 2, ["src_line"]).collect()}
    assert sel[1][0] and sel[3] == (False, ["unknown_category"]) and sum(v[0] for v in sel.values()) == 2


@pytest.mark.parametrize("counts,target,want", [({"a": 5, "b": 5, "c": 5}, 10, {"a": 4, "b": 3, "c": 3}), ({"a": 2, "b": 1}, 9, {"a": 2, "b": 1}), ({"a": 0, "b": 7}, 3, {"a": 0, "b": 3}), ({}, 3, {})])
def test_quotas(spark, counts, target, want):
    df = spark.createDataFrame(list(counts.items()), "g string, n long")
    assert {r["g"]: r["quota"] for r in C.hamilton_quota(df, "g", target).collect()} == want


def test_keep_k(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("", 4), (None, 5), ("b", 6)], "k string, i int")
    ids = lambda d: sorted(r["i"] for r in d.collect())
    assert ids(C.keep_k(df, ["k"], ["i"], 2)) == [1, 2, 6] and ids(C.keep_k(df, ["k"], ["i"], 2, last=True)) == [2, 3, 6] and ids(C.keep_k(df, ["k"], ["i"], 0)) == [1, 6]


def test_repair(spark):
    blocks = spark.createDataFrame([('    "instruction": "i",\n "user_question": "怎么了。",\n "log": "no ROOM",\n "category": "cuda_memory",\n "severity": "HIGH ",\n "summary": "灾难",\n "missing_info": ["无需附加追踪。"],\n',)], "value string")
    r = R.clean_record(R.parse_blocks(blocks)).first()
    o = r["output"]
    assert r["input"]["user_question"] == "怎么了" and (o["category"], o["severity"], o["summary"]) == ("training", "high", "问题。")
    assert tuple(o["missing_info"]) == K.MISSING_INFO["training/oom"] and tuple(o["next_steps"]) == K.NEXT_STEPS["training/oom"] and o["root_cause"] == K.ROOT_CAUSES["training"]
    dep = R.clean_record(frame(spark, record(category="dependency", missing=()))).first()["output"]
    assert tuple(dep["missing_info"]) == K.MISSING_INFO["dependency/no version"]


def test_views_and_splits(spark):
    v = V.training_view(frame(spark, record())).first()
    assert v["input"] == "用户问题: q\n环境: env\n命令: cmd\n日志:\nRuntimeError" and json.loads(v["output"])["severity"] == "high"
    df = spark.range(50).withColumnRenamed("id", "o")
    s = V.exact_split(df, "o", 50, 10, 5).cache()
    assert s.where("split = 'eval'").count() == 10 and s.where("smoke and split = 'train'").count() == 5 and s.where("smoke").count() == 5
    with pytest.raises(ValueError):
        V.exact_split(df, "o", 50, 50, 1)
    assert V.sample_rows(df, "o", 7).count() == 7 and V.sample_rows(df, "o", 0).count() == 50


def test_metrics(spark):
    good = {"category": "data", "severity": "low", "summary": "s", "root_cause": "r", "missing_info": ["m"], "next_steps": ["n"]}
    outs = [good, {**good, "extra": 1}, {k: v for k, v in good.items() if k != "category"}, {**good, "category": ["data"]}, {**good, "next_steps": []}, {**good, "root_cause": ["x"]}]
    rows = [(i, json.dumps(o), json.dumps({"category": "data"})) for i, o in enumerate(outs)] + [(6, "no", None), (7, "", "{}")]
    m = {r["i"]: r["metrics"] for r in E.rule_metrics(spark.createDataFrame(rows, "i int, raw_output string, ref string"), reference="ref").collect()}
    assert [m[i]["schema_valid"] for i in range(8)] == [True] + [False] * 7
    assert m[1]["required_fields_present"] and not m[1]["no_extra_top_level_fields"] and not m[2]["required_fields_present"] and not m[3]["category_enum_valid"]
    assert m[0]["category_matches_reference"] and m[0]["severity_matches_reference"] is False and m[6]["category_matches_reference"] is None and m[6]["parse_error"]


def test_judging_and_preferences(spark):
    kind = "sample_id string, winner string, winner_confidence string, candidate_a string, candidate_b string, overall_scores struct<A_score:int,B_score:int>, dimension_winners map<string,string>, dimension_scores map<string,struct<A_score:int,B_score:int>>"
    rows = [("p", "A", "high", "a1", "b1", (5, 3), {"d": "A"}, {"d": (5, 3)}), ("p", "B", "medium", "a2", "b2", None, {"d": "tie"}, {"d": (None, 3)}), ("p", "B", "high", "a3", "b3", (1, 5), {}, {}), ("q", "tie", "high", "a", "b", (3, 3), {}, {}), ("q", "A", "low", "a", "b", (4, 3), {}, {})]
    df = spark.createDataFrame(rows, kind)
    s = E.judge_summary(df).first()
    assert (s["n_a"], s["n_b"], s["n_tie"], s["n_usable"], s["n_high"], s["a_rate"]) == (2, 2, 1, 4, 2, 0.5)
    assert E.judge_summary(df.where("winner = 'tie'")).first()["a_rate"] is None
    d = E.dimension_stats(df).first()
    assert (d["n_a"], d["n_tie"], d["a_sum"], d["n_scored"], d["delta"]) == (1, 1, 5, 1, -2.0)
    p = E.preference_rows(df)
    assert [(r["chosen"], r["score_delta"]) for r in E.top_pairs(p, 1, ["high"], ["chosen"]).collect()] == [("b3", 4.0)]
    assert E.top_pairs(p, 2, ["high", "medium"], ["chosen"]).count() == 2
    back = E.swap_sides(df, F.lit(True)).orderBy("candidate_a").collect()
    assert [r["winner"] for r in back if r["candidate_a"] == "a1"] == ["B"] and [r["overall_scores"]["A_score"] for r in back if r["candidate_a"] == "a1"] == [3]
    old = E.swap_sides(df, F.lit(True), legacy_scores=True).where("candidate_a = 'a1'").first()
    assert old["winner"] == "B" and old["overall_scores"]["A_score"] == 5
    gate = spark.createDataFrame([(True, False), (False, True), (None, False), (True, True)], "a boolean, b boolean").select(*E.schema_gate(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in gate] == ["A", "B", "tie", None]
    a, b = spark.createDataFrame([("x", 1), ("y", 2)], "sample_id string, v int"), spark.createDataFrame([("x", 3)], "sample_id string, v int")
    assert E.pair_results(a, b).count() == 1
    with pytest.raises(Exception, match="no right row"):
        E.pair_results(a, b, required=True).collect()


def test_sources_and_sinks(spark, tmp_path):
    f = tmp_path / "a.jsonl"
    f.write_text('{"sample_id": "x", "v": 1}\n\n{"sample_id": "x", "v": 2}\n{"sample_id": "", "v": 3}\n', encoding="utf-8")
    r = readers.read_records(spark, [str(f), str(tmp_path / "none")], "sample_id string, v int", missing_ok=True)
    assert sorted(x["src_line"] for x in r.collect()) == [1, 3, 4] and readers.count_lines(spark, str(f)) == 3 and readers.count_lines(spark, "/none/x") == 0
    assert {x["sample_id"]: x["v"] for x in readers.read_keyed(spark, str(f), "sample_id string, v int").collect()}["x"] == 2
    assert "train_004" in [x["sample_id"] for x in readers.with_sample_ids(r, "src_line").collect()]
    g = tmp_path / "a.json"
    g.write_text('[{"v": 1}, {"v": 2}]')
    assert readers.read_dataset(spark, str(g), "v int", 1).count() == 1
    g.write_text('{"v": 1}')
    with pytest.raises(ValueError):
        readers.read_json_array(spark, str(g), "v int")
    assert readers.scalar("1e3") == 1000.0 and readers.scalar("'x'") == "x" and readers.scalar("~") is None and readers.variant_spec("n=c.yaml@e.json", "/r") == {"name": "n", "config": "/r/c.yaml", "eval_data": "/r/e.json"}
    assert readers.label_of("/x/m_results.jsonl") == "m"
    env = {}
    (tmp_path / ".env").write_text("A='1'\n# B=2\nexport C=3\n")
    readers.read_env(str(tmp_path / ".env"), into=env)
    assert env == {"A": "1", "C": "3"}
    assert sinks.write_json_array(r.select("v"), str(tmp_path / "o.json"), ["v"]) == 3 and json.loads((tmp_path / "o.json").read_text()) == [{"v": 1}, {"v": 2}, {"v": 3}]
    sinks.update_catalog(str(tmp_path / "c.json"), V.catalog_entry("a", "a.json"))
    assert set(sinks.update_catalog(str(tmp_path / "c.json"), V.catalog_entry("b", "b.json", True))) == {"a", "b"}
    sinks.write_jsonl(r.select("v"), str(tmp_path / "out"))
    out = feeds.flush(feeds.stream_jsonl(spark, str(tmp_path / "out"), "v int"), str(tmp_path / "pq"), str(tmp_path / "cp"))
    out.awaitTermination(60)
    feeds.flush(feeds.stream_jsonl(spark, str(tmp_path / "out"), "v int"), str(tmp_path / "pq"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "pq")).count() == 3


def test_model_calls(spark):
    def fail(system, prompt):
        if prompt == "bad":
            raise RuntimeError("down")
        return json.dumps({"generated": [{"seed_id": 1, "samples": [{"instruction": "i"}, {"instruction": "j"}]}]})

    df = spark.createDataFrame([("good", "s"), ("bad", "s")], "prompt string, system string")
    out = {r["prompt"]: r for r in G.call_model(df, lambda: G.FakeClient(answer=fail)).withColumn("n", F.size(G.parse_generated(F.col("raw_output")))).collect()}
    assert out["good"]["error"] is None and out["good"]["n"] == 2 and "down" in out["bad"]["error"] and out["bad"]["raw_output"] is None
    seeds = readers.read_seeds(frame(spark, record(), record(), record(category="data")), ["src_line"], "training")
    assert G.expansion_prompts(seeds, 1).count() == 2
    both = G.generate_pairs(df.limit(1), lambda: G.FakeClient(1), lambda: G.FakeClient(2)).first()
    assert both["candidate_a"] != both["candidate_b"]
    assert G.response_text({"choices": [{"message": {"content": [{"type": "text", "text": " a"}, {"type": "x"}]}}]}) == "a"
    assert feeds.collect_until(3, 5, lambda: spark.createDataFrame([("a", 1)], "category string, n long"), lambda c: None, ["a", "b"]) == ["b"] * 5


def test_judged_pairs_are_turned_back_and_gated(spark):
    rows = [(f"s{i}", None, "task", "x", f"good {i}", "y", f"poor {i}", None, True, True) for i in range(30)]
    rows += [("gate", None, "task", "x", "o", "y", "o", None, False, True), ("none", None, "task", "x", "o", "y", "o", None, None, False), ("odd", "sys", "task", "x", "odd", "y", "odd", None, True, True), ("down", None, "task", "x", "down", "y", "down", None, True, True)]
    df = spark.createDataFrame(rows, "sample_id string, system string, prompt string, a_label string, a_output string, b_label string, b_output string, reference_output string, a_valid boolean, b_valid boolean")

    def answer(system, prompt):
        assert system == "judge"
        if "down" in prompt:
            raise TimeoutError("late")
        if "odd" in prompt:
            return '{"winner": "C", "reason": "?"}'
        a = prompt.index("good") < prompt.index("poor")
        hi, lo = (9, 2) if a else (2, 9)
        return json.dumps({"winner": "A" if a else "B", "winner_confidence": "high", "dimension_winners": {"d": "A" if a else "B"}, "dimension_scores": {"d": {"A_score": hi, "B_score": lo}}, "overall_scores": {"A_score": hi, "B_score": lo}, "reason": "r"})

    got = {r["sample_id"]: r for r in G.judge_pairs(df, lambda: G.FakeClient(answer=answer), "judge").collect()}
    assert len(got) == len(rows)
    own = [got[f"s{i}"] for i in range(30)]
    assert {r["swapped"] for r in own} == {True, False}
    assert all((r["winner"], r["overall_scores"]["A_score"], r["dimension_winners"], r["dimension_scores"]["d"]["B_score"], r["a_output"][:4], r["a_label"], r["source"], r["error"]) == ("A", 9, {"d": "A"}, 2, "good", "x", "judge", None) for r in own)
    assert (got["gate"]["winner"], got["gate"]["source"], got["gate"]["winner_confidence"], got["gate"]["elapsed_seconds"]) == ("B", "schema_gate", "high", None) and got["none"]["winner"] == "tie"
    assert (got["odd"]["winner"], got["odd"]["error"]) == (None, "bad_judgement") and (got["down"]["winner"], got["down"]["error"]) == (None, "TimeoutError: late")
    assert G.judge_pairs(df.limit(0), lambda: G.FakeClient(), "judge").count() == 0


def test_rows_cross_variants(spark):
    got = G.cross_variants(spark.range(3), [{"variant": "base", "adapter": None}, {"variant": "tuned", "adapter": "p"}]).collect()
    assert sorted((r["id"], r["variant"], r["adapter"]) for r in got) == sorted([(i, v, a) for i in range(3) for v, a in (("base", None), ("tuned", "p"))], key=lambda x: (x[0], x[1]))
    with pytest.raises(ValueError):
        G.cross_variants(spark.range(3), [{"ID": "x"}])


def test_expansion_parses_validates_and_counts(spark):
    seeds = frame(spark, *[record(question=f"q{i}") for i in range(5)]).withColumnRenamed("src_line", "seed_id")

    def answer(system, text):
        asked = [x["seed_id"] for x in json.loads(text)["seeds"]]
        if 4 in asked:
            raise OSError("down")
        if 2 in asked:
            return "no JSON"
        names = ("instruction", "input", "output")
        (i, n, o) = record()
        good = dict(zip(names, (i, dict(zip(K.DIAGNOSIS.inputs, n)), dict(zip(K.DIAGNOSIS.outputs, o)))))
        return json.dumps({"generated": [{"seed_id": s, "samples": [good, {**good, "instruction": "x"}]} for s in asked]})

    out = G.expand(seeds, lambda: G.FakeClient(answer=answer), "s").collect()
    assert sorted((r["seed_id"], tuple(r["reasons"])) for r in out if r["seed_id"] is not None) == [(i, x) for i in (0, 1) for x in ((), ("instruction mismatch",))]
    rows = spark.createDataFrame(out, "chunk long, seed_id int, " + K.RECORD_DDL + ", elapsed_seconds double, error string, reasons array<string>")
    got = {r["chunk"]: (r["n_valid"], r["n_invalid"], r["error"]) for r in G.batch_stats(rows).collect()}
    assert got == {0: (2, 2, None), 1: (0, 0, None), 2: (0, 0, "OSError: down")}


def test_overall_scores(spark):
    df = spark.createDataFrame([((1, 3),), ((2, None),), ((4, 5),), (None,)], "overall_scores struct<A_score:int, B_score:int>")
    assert tuple(E.overall_stats(df).first()) == (2.5, 4.0, 1.5, 2) and tuple(E.overall_stats(df.limit(0)).first()) == (None, None, None, 0)


def test_json_that_cannot_be_stored_as_it_is(spark):
    assert parse_strict('{"\\ud800": "a\\udfff"}')[2:4] == (["?"], {"?": "a?"})
    bad = spark.sql(r"select cast(x'7b2261223a2022ff227d' as string) as x").select(strict_json(F.col("x")).alias("o")).first()["o"]
    assert bad["ok"] and bad["scalars"] == {"a": "�"}
    deep = parse_strict("[" * 100_000)
    assert not deep[0] and deep[1]


def test_arrays_without_items(spark, tmp_path):
    (tmp_path / "a.json").write_text(" [] ")
    assert readers.read_json_array(spark, str(tmp_path / "a.json"), "v int").count() == 0
    with pytest.raises(ValueError, match="no items"):
        readers.read_json_array(spark, str(tmp_path / "a.json"), "v int", allow_empty=False)


def test_rates_round_ties_to_even(spark):
    df = spark.createDataFrame([("v", (i == 0,)) for i in range(32)], "variant string, metrics struct<json_parse_success:boolean>")
    assert E.metric_summary(df, flags=("json_parse_success",), optional=()).first()["rate"] == 0.0312


def test_places_of_rows_that_tie_and_of_none(spark):
    df = spark.range(1000).repartition(7).selectExpr("id % 3 as k", "id")
    got = C.numbered(df, ["k", "id"], "n", 1).collect()
    assert sorted((r["k"], r["id"]) for r in got) == [(r["k"], r["id"]) for r in sorted(got, key=lambda r: r["n"])] and {r["n"] for r in got} == set(range(1, 1001))
    assert C.numbered(df.limit(0), ["k"]).count() == 0 and C.chunked(df, ["id"], 300).select("chunk").distinct().count() == 4


def test_splits_and_draws_that_cannot_be(spark):
    with pytest.raises(ValueError, match="hash_split"):
        V.exact_split(spark.range(1), "id", 1_000_001, 5, 5)
    assert V.exact_sample(spark.range(5), "id", 5, 9, key="id").count() == 5 and V.exact_sample(spark.range(5), "id", 5, 0, key="id").count() == 5
    with pytest.raises(ValueError, match="no matrix"):
        G.variant_matrix("none", {}, {})


def test_first_k_over_several_batches(spark, tmp_path):
    out = str(tmp_path / "out")
    for i in range(2):
        sinks.write_jsonl(spark.createDataFrame([("a", 10 * i + j) for j in range(2)] + [(None, 1), ("b", 10 * i)], "k string, v int"), str(tmp_path / "in"), append=True)
        stream = feeds.first_k(feeds.stream_jsonl(spark, str(tmp_path / "in"), "k string, v int"), "k", "v", 3)
        feeds.flush(stream, out, str(tmp_path / "cp")).awaitTermination()
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(out).collect()) == [("a", 0), ("a", 1), ("a", 10), ("b", 0), ("b", 10)]
