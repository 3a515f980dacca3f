"""Queries, and their SQL, of what reads and writes files, calls models (always fakes here) or works on streams."""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import contracts as K
from ..functions import text as T
from ..functions.jsonx import strict_json
from ..operators import curate as C
from ..operators import evaluate as E
from ..operators import generate as G
from ..operators import repair as R
from ..operators import views as V
from ..sources import readers, sinks
from ..streaming import feeds
from .catalog import _MADE, _P, _REASONS, _made, _reasons, _sides, query, table


def _values(columns: str, rows: list[tuple]) -> str:
    """SQL of literal rows."""
    lit = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"select * from (values {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) v({columns})"


def _file(spark, lines: DataFrame, name: str) -> str:
    """A file of the values of lines, in order of item_id."""
    return sinks.write_lines_file(lines, f"{sinks.scratch(spark, 'file')}/{name}", "item_id")


# ---- files


@query("select item_id, (row_number() over (order by item_id) + count(*) filter (item_id % 5 = 0) over (order by item_id))::bigint as src_line, 0 as src_idx from benchmark")
def lines_with_lineage(spark, d):
    """Blank lines are counted, a file that isn't there is none."""
    value = F.concat(F.when(F.col("item_id") % 5 == 0, "\n").otherwise(""), F.to_json(F.struct("item_id")))
    path = _file(spark, table(spark, d, "benchmark").select("item_id", value.alias("value")), "a.jsonl")
    return readers.read_records(spark, [path, f"{path}.none"], "item_id long", missing_ok=True).select("item_id", "src_line", "src_idx")


@query("with n as (select item_id, row_number() over (order by item_id) as src_line from benchmark) select 'array' as kind, * from n where src_line <= 7 union all select 'lines', * from n union all select 'all', * from n")
def datasets_by_suffix(spark, d):
    b = table(spark, d, "benchmark").select("item_id", F.to_json(F.struct("item_id")).alias("value"))
    array = _file(spark, b.agg(F.lit(0).alias("item_id"), F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "value"))), lambda x: x["value"]), ",\n"), F.lit("]")).alias("value")), "a.json")
    kinds = (("array", array, 7), ("all", array, 0), ("lines", _file(spark, b, "a.jsonl"), 0))
    return V.union_ordered(*[readers.read_dataset(spark, p, "item_id long", n).select(F.lit(k).alias("kind"), "item_id", "src_line") for k, p, n in kinds]).drop("union_idx")


@query("select row_number() over (order by item_id) as src_line, 'c' || item_id % 3 as category, 'a \"b\"' || item_id as summary, 's' as steps from benchmark")
def seed_blocks(spark, d):
    """A malformed array of objects, cut into blocks and read a key a line."""
    i = F.col("item_id")
    one = F.concat(F.lit('    "category": "c'), i % 3, F.lit('",\n    "summary": "a \\"b\\"'), i, F.lit('",\n    "next_steps": ["s", " "],'))
    b = table(spark, d, "benchmark").select("item_id", one.alias("value"))
    text = F.concat(F.lit("[\n  {\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "value"))), lambda x: x["value"]), "\n  },\n  {\n"), F.lit("\n  }\n]"))
    path = _file(spark, b.agg(F.lit(0).alias("item_id"), text.alias("value")), "seeds.txt")
    t = R.parse_blocks(readers.read_blocks(spark, path))
    return t.select("src_line", "output.category", "output.summary", F.array_join("output.next_steps", "|").alias("steps"))


@query(f"with {_MADE} select doc_id, row_number() over (order by doc_id) - 1 as seed_id from made where category = 'data' order by doc_id limit 20")
def numbered_seeds(spark, d):
    return readers.read_seeds(_made(spark, d), ["doc_id"], "data", 20).select("doc_id", "seed_id")


@query("select 'file' as name, count(*) as n from benchmark union all select 'none', 0")
def line_counts(spark, d):
    path = _file(spark, table(spark, d, "benchmark").select("item_id", F.concat(F.col("item_id"), F.lit("\n ")).alias("value")), "a.txt")
    return spark.createDataFrame([("file", readers.count_lines(spark, path)), ("none", readers.count_lines(spark, f"{path}.none"))], "name string, n long")


@query(_values("place, name, value", [
    ("yaml", "a", "None"), ("yaml", "b", "True"), ("yaml", "c", "'x: y'"), ("yaml", "d", "7"), ("yaml", "e", "0.5"), ("yaml", "f", "'text'"), ("pairs", "A", "'1'"), ("pairs", "B", "'\"2'"), ("pairs", "C", "'kept'"), ("any", "A", "'1'"), ("any", "B", "'2'"), ("any", "C", "'kept'"),
    ("first", "x", "'kept'"), ("first", "y", "'none'"), ("variant", "n", "'/r/c.yaml /r/e.json'"), ("variant", "m", "'/abs None'"), ("label", "a", "'run'"), ("label", "b", "'other'"),
    ("device", "CUDA:0 ", "{'': 0}"), ("device", "cpu", "{'': 'cpu'}"), ("device", "auto", "'auto'"),
]))
def configuration(spark, d):
    """Flat YAML, both dialects of environment files, the first variable that is set, variant specifications, labels of files, device maps."""
    home = Path(tempfile.mkdtemp())
    (home / "c.yaml").write_text("# note\n\na: null\nb: true\nc: \"x: y\"\nd: 7\ne: 0.5\nf: text\n", encoding="utf-8")
    (home / ".env").write_text("export A='1'\nB=\"2\n# no\nC=new\n", encoding="utf-8")
    rows = [("yaml", k, repr(v)) for k, v in readers.read_flat_yaml(str(home / "c.yaml")).items()]
    for place, paired in (("pairs", True), ("any", False)):
        env = {"C": "kept"}
        readers.read_env(str(home / ".env"), paired, env)
        rows += [(place, k, repr(v)) for k, v in env.items()]
    rows += [("first", "x", repr(readers.env_first("Z", "C", env=env))), ("first", "y", repr(readers.env_first("Z", default="none", env=env)))]
    for spec in ("n=c.yaml@e.json", "m=/abs"):
        v = readers.variant_spec(spec, "/r")
        rows.append(("variant", v["name"], repr(f"{v['config']} {v['eval_data']}")))
    rows += [("label", "a", repr(readers.label_of("/x/run_results.jsonl"))), ("label", "b", repr(readers.label_of("other.jsonl")))]
    rows += [("device", x, repr(readers.runtime_overrides({"device_map": x})["device_map"])) for x in ("CUDA:0 ", "cpu", "auto")]
    return spark.createDataFrame(rows, "place string, name string, value string")


@query("""with p as (select unnest(['default_prompt', 'strict_json_prompt', 'qwen25_3b_default_prompt', 'qwen25_3b_strict_json_prompt', 'qwen3_4b_default_prompt', 'qwen3_4b_strict_json_prompt']) as prompt), m as (select prompt as matrix, prompt from p union all select 'both', prompt from p where prompt in ('default_prompt', 'strict_json_prompt'))
select matrix, prompt || '_' || kind as name, prompt || '_' || kind || '.yaml' as config, case when contains(prompt, 'strict') then 's.json' else 'd.json' end as eval_data from m cross join (select unnest(['base', 'lora']) as kind)""")
def variant_matrices(spark, d):
    configs = {f"{p}_{k}": f"{p}_{k}.yaml" for p in K.MATRICES for k in ("base", "lora")}
    rows = [(m, v["name"], v["config"], v["eval_data"]) for m in K.MATRICES for v in G.variant_matrix(m, configs, {"default": "d.json", "strict": "s.json"})]
    return spark.createDataFrame(rows, "matrix string, name string, config string, eval_data string")


@query("select lang, 2 * count(*) as n from documents group by lang")
def appended_lines(spark, d):
    path = sinks.scratch(spark, "rows")
    for more in (False, True):
        sinks.write_jsonl(table(spark, d, "documents").select("doc_id", "lang"), path, append=more)
    return readers.read_jsonl(spark, path, "doc_id long, lang string").groupBy("lang").agg(F.count("*").alias("n"))


@query(f"with {_REASONS} select doc_id, len(reasons) = 0 as kept, nullif(array_to_string(reasons, ','), '') as reasons from r")
def routed_files(spark, d):
    """Kept and rejected rows in folders of their own."""
    kept, rejected = sinks.scratch(spark, "kept"), sinks.scratch(spark, "rejected")
    sinks.write_routed(_reasons(spark, d).select("doc_id", "reasons"), kept, rejected)
    a = readers.read_jsonl(spark, kept, "doc_id long").select("doc_id", F.lit(True).alias("kept"), F.lit(None).cast("string").alias("reasons"))
    return a.unionByName(readers.read_jsonl(spark, rejected, "doc_id long, reasons array<string>").select("doc_id", F.lit(False).alias("kept"), F.array_join("reasons", ",").alias("reasons")))


@query("with n as (select item_id, row_number() over (order by item_id desc) as place from benchmark) select 'array' as kind, * from n union all select 'lines', item_id, null from n")
def lines_and_array(spark, d):
    """The same rows as JSON lines and as one ordered JSON array."""
    lines, array = sinks.scratch(spark, "lines"), f"{tempfile.mkdtemp()}/a.json"
    sinks.write_both(table(spark, d, "benchmark").select("item_id"), lines, array, [F.desc("item_id")])
    got = [("array", x["item_id"], i) for i, x in enumerate(json.loads(Path(array).read_text(encoding="utf-8")), 1)]
    return spark.createDataFrame(got, "kind string, item_id long, place long").unionByName(readers.read_jsonl(spark, lines, "item_id long").select(F.lit("lines").alias("kind"), "item_id", F.lit(None).cast("long").alias("place")))


@query(_values("what, value", [("moved", "['a.json']"), ("archived", "new"), ("backup", "raw raw"), ("catalog", "['a', 'b']"), ("entry", "a2.json instruction"), ("ranking", "True rejected"), ("folder", "True"), ("manifest", "{'n': 3, 'k': 2}"), ("log", "['down']")]))
def housekeeping(spark, d):
    """Files that the driver keeps: an archive, a raw backup made once, the catalog, a run's folder and manifest, and the log of errors."""
    home = Path(tempfile.mkdtemp())
    (home / "a.json").write_text("new")
    (home / "old").mkdir()
    (home / "old" / "a.json").write_text("old")
    moved = sinks.archive([str(home / "a.json"), str(home / "b.json")], str(home / "old"))
    (home / "s.json").write_text("raw")
    first = sinks.backed_up_text(str(home / "s.json"), str(home / "raw" / "s.json"))
    (home / "s.json").write_text("clean")
    again = sinks.backed_up_text(str(home / "s.json"), str(home / "raw" / "s.json"))
    for name, file, ranked in (("a", "a.json", False), ("b", "b.json", True), ("a", "a2.json", False)):
        catalog = sinks.update_catalog(str(home / "c.json"), V.catalog_entry(name, file, ranked))
    run = sinks.run_folder(str(home), "judge")
    manifest = sinks.write_manifest(spark.createDataFrame([(3,)], "n int"), f"{run}/m.json", k=2)
    log = sinks.scratch(spark, "log")
    for error in ("down", None):
        sinks.write_log(spark.createDataFrame([(1, error)], "chunk int, error string"), log)
    errors = [r["error"] for r in readers.read_jsonl(spark, log, "chunk int, error string").collect()]
    same = json.loads(Path(f"{run}/m.json").read_text()) == manifest
    rows = [("moved", str([Path(p).name for p in moved])), ("archived", (home / "old" / "a.json").read_text()), ("backup", f"{first} {again}"), ("catalog", str(sorted(catalog))), ("entry", f"{catalog['a']['file_name']} {catalog['a']['columns']['prompt']}")]
    rows += [("ranking", f"{catalog['b']['ranking']} {catalog['b']['columns']['rejected']}"), ("folder", str(bool(re.fullmatch(r"judge_\d{8}_\d{6}", Path(run).name)))), ("manifest", str(manifest) if same else ""), ("log", str(errors))]
    return spark.createDataFrame(rows, "what string, value string")


# ---- records


_FAULTY = f"""{_MADE}, faulty as (select *, doc_id % 7 <> 0 as told, doc_id % 11 <> 0 as has_in, doc_id % 13 <> 0 as has_out from made),
checked as (select *, list_filter([case when not told then 'schema.instruction' end, case when not has_in then 'schema.input' end, case when has_in and not has_out then 'schema.output' end,
case when has_in and has_out and question = '' then 'schema.input.user_question' end, case when has_in and has_out and category = 'odd' then 'schema.output.category' end, case when has_in and has_out and summary = '' then 'schema.output.summary' end,
case when has_in and has_out and root = '' then 'schema.output.root_cause' end, case when has_in and has_out and weak = '' then 'schema.output.next_steps' end], lambda x: x is not null) as codes from faulty)"""


def _faulty(spark, d):
    i = F.col("doc_id")
    return _made(spark, d).withColumns({"instruction": F.when(i % 7 != 0, F.col("instruction")).otherwise("x"), "input": F.when(i % 11 != 0, F.col("input")), "output": F.when(i % 13 != 0, F.col("output"))})


@query(f"with {_FAULTY} select doc_id, array_to_string(codes, ',') || case when has_in and has_out and category <> 'data' then case when len(codes) > 0 then ',' else '' end || 'category_mismatch' else '' end as reasons from checked")
def record_reasons(spark, d):
    return _faulty(spark, d).select("doc_id", F.array_join(C.schema_reasons(expected=F.lit("data")), ",").alias("reasons"))


@query(f"""with {_FAULTY} select doc_id, replace(array_to_string(list_filter(list_concat(codes, [case when not has_in and not has_out then 'schema.output' end]), lambda x: x is not null), ','), 'schema.', 's.') as reasons from checked""")
def sample_codes(spark, d):
    """The second code table, turned back so that each code is held against its own condition."""
    back = {v: k for k, v in K.SAMPLE_CODES.items()}
    codes = F.transform(C.sample_reasons(), lambda x: F.element_at(F.create_map(*[F.lit(y) for kv in back.items() for y in kv]), x))
    return _faulty(spark, d).select("doc_id", F.regexp_replace(F.array_join(codes, ","), r"schema\.", "s.").alias("reasons"))


@query(f"""with {_FAULTY}, n as (select *, row_number() over (partition by len(codes) = 0, category, question, log order by doc_id) as nth from checked)
select doc_id, case when len(codes) > 0 then array_to_string(list_sort(codes), ',') when nth > 1 then 'duplicate.question_log' else '' end as reasons from n""")
def valid_duplicates(spark, d):
    """The first valid record of each category, question and log stays; records with faults never stand for others."""
    return C.validate_and_dedup(_faulty(spark, d), ["doc_id"]).select("doc_id", F.array_join("reasons", ",").alias("reasons"))


def _json_list(c: str) -> str:
    return f"'[' || chr(10) || '    \"' || array_to_string({c}, '\",' || chr(10) || '    \"') || '\"' || chr(10) || '  ]'"


@query(f"""with {_MADE} select md5('用户问题: ' || question || chr(10) || '环境: e' || chr(10) || '命令: c' || chr(10) || '日志:' || chr(10) || log) as input_md5, '{K.VIEW_INSTRUCTION}' as instruction, '{K.VIEW_SYSTEM}' as system,
md5('{{' || chr(10) || '  "category": "' || category || '",' || chr(10) || '  "severity": "' || severity || '",' || chr(10) || '  "summary": "' || summary || '",' || chr(10) || '  "root_cause": "' || root || '",' || chr(10)
|| '  "missing_info": ' || {_json_list('missing')} || ',' || chr(10) || '  "next_steps": ' || {_json_list('steps')} || chr(10) || '}}') as output_md5 from made""")
def training_views(spark, d):
    return V.training_view(_made(spark, d)).select(F.md5("input").alias("input_md5"), "instruction", "system", F.md5("output").alias("output_md5"))


@query(f"with {_MADE} select '{K.INSTRUCTION}' as instruction, question, category from made")
def kept_fields(spark, d):
    t = V.keep_fields(V.drop_internal(_made(spark, d).withColumn("_line", F.col("doc_id"))))
    return t.select("instruction", F.col("input.user_question").alias("question"), "output.category")


@query("select doc_id, 'q' || doc_id as question from documents")
def trimmed_questions(spark, d):
    task = F.struct(F.concat(F.lit(" q"), "doc_id", F.repeat(F.lit("。"), (F.col("doc_id") % 3).cast("int"))).alias("user_question"), *[F.lit(None).cast("string").alias(k) for k in ("environment", "command", "log")])
    t = R.clean_record(_made(spark, d).withColumn("input", task))
    return t.select("doc_id", F.col("input.user_question").alias("question"))


@query("select doc_id, coalesce(lang, 'none') || '。|' || coalesce(source, 'none') || '，x。|问题!' as items from documents")
def tidied_lists(spark, d):
    lang, source = (F.coalesce(c, F.lit("none")) for c in ("lang", "source"))
    items = F.array(lang, F.lit(" "), F.concat(F.lit("\n "), lang), F.lit("无需附加追踪。"), F.concat(source, F.lit("，，，x")), F.lit("灾难!"))
    return table(spark, d, "documents").select("doc_id", F.array_join(T.tidy_list(items), "|").alias("items"))


_CASES = [
    (1, '{"a": "x", "b": [1, 2]}', True, None, "a,b", "a:str,b:list", 2), (2, ' {"a": 1.5, "a": null}\n', True, None, "a", "a:NoneType", None), (3, '{"a": NaN, "b": true}', True, None, "a,b", "a:float,b:bool", None), (4, '{"a": "\\ud800\\u00e9"}', True, None, "a", "a:str", None),
    (5, "[1]", False, "Top-level JSON is list, expected object", "", "", None), (6, "null", False, "Top-level JSON is NoneType, expected object", "", "", None), (7, "'x'", False, "Expecting value at line 1 column 1", "", "", None), (8, '{"a": 1} x', False, "Extra data at line 1 column 10", "", "", None),
    (9, '{"a": 1,\n}', False, None, "", "", None), (10, '{"a": "x', False, "Unterminated string starting at at line 1 column 7", "", "", None), (11, "", False, "Expecting value at line 1 column 1", "", "", None), (12, None, False, "Expecting value at line 1 column 1", "", "", None), (13, '{"\\udfff": 7}', True, None, "?", "?:int", None),
]


@query(_values("i, ok, error, keys, kinds, n", [(i, ok, error, keys, kinds, n) for i, _, ok, error, keys, kinds, n in _CASES]))
def strict_json_cases(spark, d):
    """What counts as one JSON object, what is said of the rest (but for one message that differs between versions), and types of values."""
    t = spark.createDataFrame([(i, x) for i, x, *_ in _CASES], "i int, x string").withColumn("o", strict_json(F.col("x")))
    kinds = F.array_join(F.array_sort(F.transform(F.map_entries("o.kinds"), lambda e: F.concat(e["key"], F.lit(":"), e["value"]))), ",")
    return t.select("i", "o.ok", F.when(F.col("i") != 9, F.col("o.error")).alias("error"), F.array_join("o.keys", ",").alias("keys"), kinds.alias("kinds"), F.try_element_at("o.sizes", F.lit("b")).alias("n"))


# ---- models


@query(_values("kind, url, headers, body", [
    ("chat", "http://h/v1/chat/completions", '{"Authorization": "Bearer k"}', '{"max_tokens": 700, "messages": [{"content": "s", "role": "system"}, {"content": "p", "role": "user"}], "model": "m", "response_format": {"type": "json_object"}, "temperature": 0.2}'),
    ("messages", "http://h/v1/v1/messages", '{"anthropic-version": "2023-06-01", "x-api-key": "k"}', '{"max_tokens": 700, "messages": [{"content": "p", "role": "user"}], "model": "m", "system": "s", "temperature": 0.2}'),
    ("judge", "http://h/v1/chat/completions", "0 400 pair_judge True False", "winner,winner_confidence,dimension_winners,dimension_scores,overall_scores,reason A,B,tie 1,2,3,4,5 5"),
    ("no key", None, None, "a key is needed"),
]))
def http_requests(spark, d):
    """What clients post; of the judge's, how its answers are held."""
    rows = []
    for kind in ("chat", "messages"):
        url, headers, body = G.HttpClient("http://h/v1/", "m", "k", kind, json_object=kind == "chat").request("s", "p")
        rows.append((kind, url, json.dumps(headers, sort_keys=True), json.dumps(body, sort_keys=True)))
    url, _, body = G.judge_client("http://h/v1", "m", "k", max_tokens=400).request("s", "p")
    held = body["response_format"]["json_schema"]
    s, p = held["schema"], held["schema"]["properties"]
    rows.append(("judge", url, f"{body['temperature']} {body['max_tokens']} {held['name']} {held['strict']} {s['additionalProperties']}", f"{','.join(s['required'])} {','.join(p['winner']['enum'])} {','.join(map(str, p['overall_scores']['properties']['A_score']['enum']))} {len(p['dimension_scores']['required'])}"))
    try:
        G.HttpClient("http://h", "m", "")
    except ValueError as e:
        rows.append(("no key", None, None, str(e)))
    return spark.createDataFrame(rows, "kind string, url string, headers string, body string")


@query(_values("i, text, prompt_tokens, completion_tokens, finish_reason, response_id", [(0, "ab", 3, 4, "end_turn", "r0"), (1, "x", 5, 6, "stop", None), (2, "y", None, None, "length", None), (3, "", None, None, None, None)]))
def response_texts(spark, d):
    shapes = [
        {"id": "r0", "content": [{"type": "text", "text": " a"}, {"type": "tool", "text": "-"}, {"type": "text", "text": "b "}], "usage": {"input_tokens": 3, "output_tokens": 4}, "stop_reason": "end_turn"},
        {"choices": [{"message": {"content": " x "}, "finish_reason": "stop"}], "usage": {"prompt_tokens": 5, "completion_tokens": 6}},
        {"choices": [{"message": {"content": [{"type": "text", "text": "y"}]}, "finish_reason": "length"}]}, {"choices": []},
    ]
    got = [(i, str(a), a.prompt_tokens, a.completion_tokens, a.finish_reason, a.response_id) for i, a in enumerate(map(G.answer_of, shapes))]
    return spark.createDataFrame(got, "i int, text string, prompt_tokens long, completion_tokens long, finish_reason string, response_id string")


@query(_values("i, code, said", [(0, 0, "pong"), (1, 1, "a key is needed"), (2, 2, "HTTP 403"), (3, 3, "OSError: down")]))
def probes(spark, d):
    import urllib.error

    def failing(error):
        def answer(system, prompt):
            raise error

        return lambda: G.FakeClient(answer=answer)

    clients = [lambda: G.FakeClient(answer=lambda s, p: "pong"), lambda: G.HttpClient("http://h", "m", ""), failing(urllib.error.HTTPError("u", 403, "no", {}, None)), failing(OSError("down"))]
    return spark.createDataFrame([(i, *G.probe(c)) for i, c in enumerate(clients)], "i int, code int, said string")


def _told(system: str, prompt: str) -> str:
    if prompt.startswith("Re"):
        raise TimeoutError("late")
    a = G.Answer(hashlib.sha256(f"{system}:{prompt}".encode()).hexdigest())
    a.prompt_tokens, a.completion_tokens, a.finish_reason = len(prompt), 64, "stop"
    return a


@query("with t as (select item_id, text, starts_with(text, 'Re') as late from benchmark) select item_id, case when not late then sha256('sys:' || text) end as raw_output, case when late then 'TimeoutError: late' end as error, case when not late then length(text)::bigint end as prompt_length, case when not late then 64::bigint end as response_length, case when not late then 'stop' end as finish_reason, true as timed from t")
def model_answers(spark, d):
    """A call for each row, four at a time, with tokens and the reason it ended; failed calls are rows with an error."""
    t = table(spark, d, "benchmark").select("item_id", F.col("text").alias("prompt"), F.lit("sys").alias("system"))
    out = G.call_model(t, lambda: G.FakeClient(answer=_told), usage=True, concurrency=4)
    return out.select("item_id", "raw_output", "error", "prompt_length", "response_length", "finish_reason", (F.col("elapsed_seconds") >= 0).alias("timed"))


@query("select item_id, sha256('1::' || text) as candidate_a, sha256('2::' || text) as candidate_b from benchmark")
def candidate_pairs(spark, d):
    t = table(spark, d, "benchmark").select("item_id", F.col("text").alias("prompt"), F.lit(None).cast("string").alias("system"))
    return G.generate_pairs(t, lambda: G.FakeClient(1), lambda: G.FakeClient(2)).select("item_id", "candidate_a", "candidate_b")


def _judge(system: str, prompt: str) -> str:
    """The output that comes first as text wins, 5 to 2; equal ones tie; without a judge's instructions nothing can be parsed."""
    a, b = re.search(r"Candidate A \(\w+\):\n(.*)\n\nCandidate B \(\w+\):\n(.*)", prompt).groups()
    won = "A" if a < b else "B" if b < a else "tie"
    scores = {"A_score": 5 if won == "A" else 2, "B_score": 5 if won == "B" else 2}
    return json.dumps({"winner": won if a[0] != "7" else "both", "winner_confidence": "high" if a[0] < b[0] else "low", "dimension_winners": {"actionability": won}, "dimension_scores": {"actionability": scores}, "overall_scores": scores, "reason": "r"})


@query(f"""with {_P}, x as (select *, md5(a_text) as a, md5(b_text) as b, av and bv as asked from p), w as (select *, case when av and not bv then 'A' when bv and not av then 'B' when not asked or a = b then 'tie' when a < b then 'A' else 'B' end as won from x where not (asked and (a[1] = '7' or b[1] = '7')))
select sample_id, case when asked then 'judge' else 'schema_gate' end as judge_source, won as winner, case when asked then case won when 'A' then 5 else 2 end end as a_score, case when asked then case won when 'B' then 5 else 2 end end as b_score, case when asked then won end as dimension,
a as candidate_a_output, b as candidate_b_output, 'even' as candidate_a_label, true as used_reference, 'ref' as reference_output, won <> 'tie' as usable_for_dpo from w""")
def judged_documents(spark, d):
    """The gate decides where a side isn't valid; a judge is shown the others in a tossed order and turned back. Rows it answers badly are left out here."""
    p = _sides(spark, d).select(F.col("sample_id").cast("string").alias("sample_id"), F.lit("").alias("system"), F.lit("task").alias("prompt"), F.lit("even").alias("a_label"), F.md5("a.text").alias("a_output"), F.lit("odd").alias("b_label"), F.md5("b.text").alias("b_output"), F.lit("ref").alias("reference_output"), F.col("a.valid").alias("a_valid"), F.col("b.valid").alias("b_valid"))
    t = G.judge_pairs(p, lambda: G.FakeClient(answer=_judge), K.JUDGE_INSTRUCTIONS, use_reference=True, concurrency=2)
    rows = E.judged_rows(t, use_reference=True).withColumn("asked", F.col("judge_source") == "judge")
    rows = rows.where(~(F.col("asked") & (F.col("candidate_a_output").startswith("7") | F.col("candidate_b_output").startswith("7"))))
    return rows.select(
        F.col("sample_id").cast("long").alias("sample_id"), "judge_source", "winner", F.col("overall_scores.A_score").alias("a_score"), F.col("overall_scores.B_score").alias("b_score"), F.try_element_at("dimension_winners", F.lit("actionability")).alias("dimension"),
        "candidate_a_output", "candidate_b_output", "candidate_a_label", "used_reference", "reference_output", "usable_for_dpo",
    )


def _expand(system: str, prompt: str) -> str:
    """Each seed as it is and, with another instruction and no log, once more; a prompt with seed 6 fails."""
    seeds = json.loads(prompt)["seeds"]
    if any(s["seed_id"] == 6 for s in seeds):
        raise OSError("down")
    parts = [{k: s[k] for k in K.RECORD_FIELDS} for s in seeds]
    return json.dumps({"generated": [{"seed_id": s["seed_id"], "samples": [p, {**p, "instruction": "x", "input": {**p["input"], "log": " "}}]} for s, p in zip(seeds, parts, strict=True)]})


_SEEDS = f"{_MADE}, seeds as (select *, row_number() over (order by doc_id) - 1 as seed_id from made where category = 'data'), own as (select * from seeds where seed_id < 12 and seed_id // 2 <> 3)"
_EXPANDED = _SEEDS + """, x as (select seed_id // 2 as chunk, seed_id::int as seed_id, unnest([false, true]) as bad, question, summary, root, weak from own),
y as (select chunk, seed_id, array_to_string(list_filter([case when bad then 'instruction mismatch' end, case when question = '' then 'bad input.user_question' end, case when bad then 'bad input.log' end, case when summary = '' then 'bad output.summary' end,
case when root = '' then 'bad output.root_cause' end, case when weak = '' then 'bad output.next_steps' end], lambda e: e is not null), ',') as reasons from x union all select 3, null, 'none.samples')"""


def _expanded(spark, d):
    seeds = readers.read_seeds(_made(spark, d), ["doc_id"], "data", 12)
    path = sinks.scratch(spark, "expanded")
    G.expand(seeds, lambda: G.FakeClient(answer=_expand)).write.parquet(path)  # calls are made once
    return spark.read.parquet(path)


@query(f"with {_EXPANDED} select * from y")
def expanded_samples(spark, d):
    return _expanded(spark, d).select("chunk", "seed_id", F.array_join("reasons", ",").alias("reasons"))


@query(f"with {_EXPANDED} select chunk, count(*) filter (reasons = '') as n_valid, count(*) filter (reasons not in ('', 'none.samples')) as n_invalid, case when chunk = 3 then 'OSError: down' end as error from y group by chunk")
def expansion_batches(spark, d):
    return G.batch_stats(_expanded(spark, d)).drop("elapsed_seconds")


# ---- streams


@query(_values("round, category", [(1, "b"), (2, "c"), (3, "a"), (4, "b"), (5, "c")]))
def collected_rounds(spark, d):
    """The smallest category is filled until there are 12 rows; a round adds two, the first to come among equals being first in the list."""
    have = {"a": 2, "b": 0, "c": 1}

    def run(category):
        have[category] += 2

    ran = feeds.collect_until(12, 9, lambda: spark.createDataFrame(list(have.items()), "category string, n long"), run, ["a", "b", "c"])
    return spark.createDataFrame(list(enumerate(ran, 1)), "round int, category string")


def _stream(spark, d, columns: list[str], schema: str):
    path = sinks.scratch(spark, "rows")
    sinks.write_jsonl(table(spark, d, "events").select(*columns), path)
    return feeds.stream_jsonl(spark, path, schema)


@query("select event_id, user_id from events where user_id is not null qualify row_number() over (partition by user_id order by event_id) <= 3")
def stream_first_k(spark, d):
    """The first three events of each user, kept by state; each micro-batch is written by a function."""
    out = sinks.scratch(spark, "firsts")
    stream = feeds.first_k(_stream(spark, d, ["event_id", "user_id"], "event_id long, user_id long"), "user_id", "event_id", 3)
    feeds.flush_each(stream, lambda df, i: df.write.mode("append").parquet(out), sinks.scratch(spark, "progress")).awaitTermination()
    return spark.read.parquet(out)


@query("select distinct user_id from events")
def stream_distinct_users(spark, d):
    """The first event of each user within a watermark."""
    out = sinks.scratch(spark, "users")
    stream = feeds.first_seen(_stream(spark, d, ["user_id", "ts"], "user_id long, ts timestamp"), ["user_id"], "ts", "1 hour")
    feeds.flush(stream, out, sinks.scratch(spark, "progress")).awaitTermination()
    return spark.read.schema("user_id long").parquet(out)
