"""Model calls as DataFrame operators: an injected client, errors as a column, and the prompts and parsers around it."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import contracts as K
from ..contracts import DIAGNOSIS, RECORD_DDL, RecordContract
from .curate import sample_reasons
from .evaluate import coin, judge_prompt, schema_gate, swap_sides


class Answer(str):
    """A client's answer that also knows its tokens, why it ended and its id; a plain text serves as well."""

    prompt_tokens: int | None = None
    completion_tokens: int | None = None
    finish_reason: str | None = None
    response_id: str | None = None


class Client(Protocol):
    def complete(self, system: str, prompt: str) -> str: ...


class FakeClient:
    """A client whose answer is a pure function of its seed and the prompt."""

    def __init__(self, seed: int = 0, answer: Callable[[str, str], str] | None = None):
        self.seed, self.answer = seed, answer

    def complete(self, system: str, prompt: str) -> str:
        return self.answer(system, prompt) if self.answer else hashlib.sha256(f"{self.seed}:{system}:{prompt}".encode()).hexdigest()


class HttpClient:
    """Posts to a chat or messages endpoint; kind is chat or messages. Only the standard library is used. json_schema: (name, schema) that an answer must follow."""

    def __init__(self, url: str, model: str, key: str, kind: str = "chat", timeout: float = 180, json_object: bool = False, temperature: float = 0.2, max_tokens: int = 700, json_schema: tuple[str, dict] | None = None):
        if not key:
            raise ValueError("a key is needed")
        self.json_schema = json_schema
        self.url, self.model, self.key, self.kind, self.timeout, self.json_object, self.temperature, self.max_tokens = url.rstrip("/"), model, key, kind, timeout, json_object, temperature, max_tokens

    def request(self, system: str, prompt: str) -> tuple[str, dict, dict]:
        """(url, headers, body)."""
        user = {"role": "user", "content": prompt}
        body = {"model": self.model, "max_tokens": self.max_tokens, "temperature": self.temperature}
        if self.kind == "messages":
            return f"{self.url}/v1/messages", {"x-api-key": self.key, "anthropic-version": "2023-06-01"}, {**body, "system": system, "messages": [user]}
        body |= {"messages": [{"role": "system", "content": system}, user]} | ({"response_format": {"type": "json_object"}} if self.json_object else {})
        if self.json_schema:
            body["response_format"] = {"type": "json_schema", "json_schema": {"name": self.json_schema[0], "schema": self.json_schema[1], "strict": True}}
        return f"{self.url}/chat/completions", {"Authorization": f"Bearer {self.key}"}, body

    def complete(self, system: str, prompt: str) -> str:
        import json
        import urllib.request

        url, headers, body = self.request(system, prompt)
        call = urllib.request.Request(url, json.dumps(body).encode(), {**headers, "Content-Type": "application/json"})
        with urllib.request.urlopen(call, timeout=self.timeout) as r:
            return answer_of(json.load(r))


def response_text(response: dict) -> str:
    """The text of a response: its content parts, or the first choice's message, a text or parts."""
    content = response.get("content")
    if content is None:
        choices = response.get("choices") or [{}]
        content = (choices[0].get("message") or {}).get("content") or ""
    if isinstance(content, str):
        return content.strip()
    return "".join(p.get("text", "") for p in content if p.get("type") == "text").strip()


def answer_of(response: dict) -> Answer:
    """The text of a response with its tokens, finish reason and id, where it has them."""
    out, usage, first = Answer(response_text(response)), response.get("usage") or {}, (response.get("choices") or [{}])[0]
    out.prompt_tokens = usage.get("prompt_tokens", usage.get("input_tokens"))
    out.completion_tokens = usage.get("completion_tokens", usage.get("output_tokens"))
    out.finish_reason, out.response_id = first.get("finish_reason") or response.get("stop_reason"), response.get("id")
    return out


def judgement_schema(dimensions: tuple[str, ...] = K.DIMENSIONS) -> dict:
    """The JSON schema of a judgement: nothing may lack and nothing may be added."""
    closed = lambda props: {"type": "object", "additionalProperties": False, "properties": props, "required": list(props)}
    choice = lambda names: {"type": "string", "enum": list(names)}
    scores = closed({f"{s}_score": {"type": "integer", "enum": list(K.SCORES)} for s in "AB"})
    each = lambda kind: closed(dict.fromkeys(dimensions, kind))
    return closed({"winner": choice(K.WINNERS), "winner_confidence": choice(K.CONFIDENCES), "dimension_winners": each(choice(K.WINNERS)), "dimension_scores": each(scores), "overall_scores": scores, "reason": {"type": "string"}})


def judge_client(url: str, model: str, key: str, name: str = "pair_judge", max_tokens: int = 500, **options) -> HttpClient:
    """A client for judge_pairs: no randomness, answers held to judgement_schema and max_tokens."""
    return HttpClient(url, model, key, temperature=0, max_tokens=max_tokens, json_schema=(name, judgement_schema()), **options)


def call_model(df: DataFrame, make_client: Callable[[], Client], prompt: str = "prompt", system: str = "system", out: str = "raw_output", usage: bool = False, concurrency: int = 1) -> DataFrame:
    """df with the client's answer, elapsed_seconds and error (null if all went well); with usage also prompt_length and
    response_length in tokens, finish_reason and raw_response_id, null where the client doesn't know them.

    A partition has a client of its own, which concurrency calls at a time share. A failed call is a row with an error: others
    go on. Put filters and limits before this; a filter after it saves no call.
    """
    if out in df.columns:
        raise ValueError(f"{out} is there already")
    schema = StructType(list(df.schema.fields)).add(out, "string").add("elapsed_seconds", "double").add("error", "string")
    known = {"prompt_length": "prompt_tokens", "response_length": "completion_tokens", "finish_reason": "finish_reason", "raw_response_id": "response_id"} if usage else {}
    for name in known:
        schema = schema.add(name, "long" if name.endswith("_length") else "string")

    def run(frames):
        import pandas as pd
        from concurrent.futures import ThreadPoolExecutor

        client = make_client()

        def ask(s, p):
            began, text, error = time.monotonic(), None, None
            try:
                text = client.complete(s or "", p or "")
            except Exception as e:  # noqa: BLE001  whatever a client raises becomes the row's error
                error = f"{type(e).__name__}: {e}"
            return text, time.monotonic() - began, error

        with ThreadPoolExecutor(max(1, concurrency)) as pool:
            for pdf in frames:
                got = list(pool.map(ask, pdf[system], pdf[prompt]))
                more = {k: pd.Series([getattr(t, a, None) for t, _, _ in got], dtype="Int64" if k.endswith("_length") else object, index=pdf.index) for k, a in known.items()}
                yield pdf.assign(**{out: [None if t is None else str(t) for t, _, _ in got], "elapsed_seconds": [x for _, x, _ in got], "error": [e for _, _, e in got], **more})

    return df.mapInPandas(run, schema)


def expansion_prompts(seeds: DataFrame, per_prompt: int = 2, variants: int = 4) -> DataFrame:
    """(chunk, prompt): seeds with seed_id in order, per_prompt to a prompt, as a JSON task with requirements."""
    from .curate import chunked

    s = chunked(seeds, ["seed_id"], per_prompt)
    items = F.transform(F.array_sort(F.collect_list(F.struct("seed_id", "instruction", "input", "output"))), lambda x: x)
    body = F.struct(F.lit(K.EXPANSION_TASK.format(n=variants)).alias("task"), F.array(*map(F.lit, K.EXPANSION_REQUIREMENTS)).alias("requirements"), items.alias("seeds"))
    return s.groupBy("chunk").agg(F.to_json(body, {"ignoreNullFields": "false"}).alias("prompt"))


def parse_generated(c: Column) -> Column:
    """Samples of a response, an array of structs (seed_id, sample); empty if it can't be parsed."""
    kind = f"struct<generated:array<struct<seed_id:int, samples:array<struct<{RECORD_DDL.replace('instruction string', 'instruction:string').replace('input struct', 'input:struct').replace('output struct', 'output:struct')}>>>>>"
    groups = F.from_json(c, kind)["generated"]
    flat = F.flatten(F.transform(F.coalesce(groups, F.array().cast(kind.partition(":")[2][:-1])), lambda g: F.transform(F.coalesce(g["samples"], F.array()), lambda s: F.struct(g["seed_id"].alias("seed_id"), s.alias("sample")))))
    return flat


def expand(seeds: DataFrame, make_client: Callable[[], Client], system: str = K.EXPANSION_SYSTEM, per_prompt: int = 2, variants: int = 4, contract: RecordContract = DIAGNOSIS, concurrency: int = 1) -> DataFrame:
    """One row for each sample that was made, and one for each chunk that made none: chunk, seed_id, instruction, input, output, reasons, elapsed_seconds and error.

    reasons are the contract's; none.samples stands where a call failed or its answer held no sample. route parts good and bad
    rows. Write the result before using it more than once, as each use makes the calls again.
    """
    told = call_model(expansion_prompts(seeds, per_prompt, variants).withColumn("system", F.lit(system)), make_client, concurrency=concurrency)
    made = told.select("chunk", "elapsed_seconds", "error", F.explode_outer(parse_generated(F.col("raw_output"))).alias("s"))
    made = made.select("chunk", F.col("s.seed_id").alias("seed_id"), F.col("s").isNull().alias("none"), "s.sample.*", "elapsed_seconds", "error")
    return made.withColumn("reasons", F.when(F.col("none"), F.array(F.lit("none.samples"))).otherwise(sample_reasons(contract))).drop("none")


def batch_stats(expanded: DataFrame) -> DataFrame:
    """For each chunk of what expand has made: n_valid, n_invalid, elapsed_seconds and error."""
    sample, bad = ~F.array_contains("reasons", "none.samples"), F.size("reasons") > 0
    return expanded.groupBy("chunk").agg(F.count_if(sample & ~bad).alias("n_valid"), F.count_if(sample & bad).alias("n_invalid"), F.max("elapsed_seconds").alias("elapsed_seconds"), F.max("error").alias("error"))


def generate_pairs(prompts: DataFrame, a: Callable[[], Client], b: Callable[[], Client], key: str = "sample_id") -> DataFrame:
    """Both models' answers to each prompt, side by side, as candidate_a and candidate_b."""
    left = call_model(prompts, a, out="candidate_a").withColumnsRenamed({"elapsed_seconds": "candidate_a_elapsed_seconds", "error": "error_a"})
    return call_model(left, b, out="candidate_b").withColumnsRenamed({"elapsed_seconds": "candidate_b_elapsed_seconds", "error": "error_b"})


JUDGEMENT = "winner string, winner_confidence string, dimension_winners map<string,string>, dimension_scores map<string,struct<A_score:int,B_score:int>>, overall_scores struct<A_score:int,B_score:int>, reason string"


def judge_pairs(df: DataFrame, make_client: Callable[[], Client], instructions: str, seed: int = 42, use_reference: bool = False, legacy_scores: bool = False, concurrency: int = 1) -> DataFrame:
    """df with source, swapped, elapsed_seconds, error and the columns of JUDGEMENT. judge_client makes clients that answer as asked.

    df has what judge_prompt reads, and a_valid and b_valid: where these decide, the schema gate's verdict stands and no call
    is made. A seeded toss for each sample_id shows the sides in either order; judgements are turned back. One that can't be
    parsed, or whose winner isn't A, B or tie, has a null winner and the error bad_judgement; a failed call keeps its own.
    """
    winner, confidence, source = schema_gate(F.col("a_valid"), F.col("b_valid"))
    gated = df.where(winner.isNotNull()).withColumns({"source": source, "swapped": F.lit(False), "elapsed_seconds": F.lit(None).cast("double"), "error": F.lit(None).cast("string"), "judged": F.struct(winner.alias("winner"), confidence.alias("winner_confidence"))})
    blank = F.from_json(F.lit("{}"), JUDGEMENT)
    gated = gated.withColumn("judged", blank.withField("winner", F.col("judged.winner")).withField("winner_confidence", F.col("judged.winner_confidence")))
    pairs = [(f"{a}_{c}", f"{b}_{c}") for c in ("label", "output") for a, b in (("a", "b"), ("b", "a"))]
    turned = {own: F.when(F.col("swapped"), F.col(other)).otherwise(F.col(own)) for own, other in pairs}
    asked = df.where(winner.isNull()).withColumns({"source": F.lit("judge"), "swapped": F.coalesce(coin(F.col("sample_id"), seed), F.lit(False))}).withColumns(turned)
    asked = asked.withColumns({"judge_system": F.lit(instructions), "judge_input": judge_prompt(use_reference)})
    told = call_model(asked, make_client, "judge_input", "judge_system", "judge_text", concurrency=concurrency).withColumns(turned)
    told = told.withColumn("judged", F.coalesce(F.from_json("judge_text", JUDGEMENT), blank))
    bad = ~F.coalesce(F.col("judged.winner").isin("A", "B", "tie"), F.lit(False))
    told = told.withColumns({"judged": F.when(bad, blank).otherwise(F.col("judged")), "error": F.coalesce("error", F.when(bad, "bad_judgement"))})
    out = gated.unionByName(told.drop("judge_system", "judge_input", "judge_text"))
    return swap_sides(out.select(*[c for c in out.columns if c != "judged"], "judged.*"), F.col("swapped"), legacy_scores=legacy_scores)


def cross_variants(rows: DataFrame, variants: list[dict[str, str | None]]) -> DataFrame:
    """Each row once for each variant, with the variants' keys as columns; these are a short list from a configuration."""
    keys = list(dict.fromkeys(k for v in variants for k in v))
    each = F.array(*[F.struct(*[F.lit(v.get(k)).cast("string").alias(k) for k in keys]) for v in variants])
    taken = {c.lower() for c in rows.columns} & {k.lower() for k in [*keys, "own_variant"]}
    if not variants or taken:
        raise ValueError(f"no variants, or columns that are there already: {sorted(taken)}")
    return rows.withColumn("own_variant", F.explode(each)).select(*rows.columns, "own_variant.*")


def variant_matrix(name: str, configs: dict[str, str], evals: dict[str, str]) -> list[dict[str, str]]:
    """The variants of a named matrix: for each of its prompts the base model and the tuned one.

    configs has a configuration for each variant's name, evals the data of the default and the strict prompt.
    """
    if name not in K.MATRICES:
        raise ValueError(f"no matrix {name}; there are {', '.join(K.MATRICES)}")
    prompts = K.MATRICES[:2] if name == "both" else (name,)
    return [{"name": f"{p}_{kind}", "config": configs[f"{p}_{kind}"], "eval_data": evals["strict" if "strict" in p else "default"]} for p in prompts for kind in ("base", "lora")]


def probe(make_client: Callable[[], Client]) -> tuple[int, str]:
    """Whether a client answers at all: (0, answer), or 1 if it lacks its key, 2 if the server refuses (its status), 3 for any other error."""
    import urllib.error

    try:
        client = make_client()
    except ValueError as e:
        return 1, str(e)
    try:
        return 0, str(client.complete("", "ping"))
    except urllib.error.HTTPError as e:
        return 2, f"HTTP {e.code}"
    except Exception as e:  # noqa: BLE001
        return 3, f"{type(e).__name__}: {e}"
