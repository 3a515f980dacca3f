"""What a task's records must look like, as data. Operators take a contract; the diagnosis task is one instance."""

from __future__ import annotations

from dataclasses import dataclass, field

# The enums, texts, rules and lists of the diagnosis task.
CATEGORIES = ("dependency", "training", "data", "inference", "deployment")
SEVERITIES = ("low", "medium", "high")
INSTRUCTION = "你是一个训练与部署问题诊断助手。请根据输入内容输出 JSON。"
DENY_LIST = (
    ("bad_api.available_chat_templates", ("available_chat_templates",)),
    ("bad_package.qwen_vl", ("pip install qwen-vl", "qwen_vl")),
    ("bad_package.transformers_all", ("pip install transformers[all]",)),
    ("bad_command.vllm_generation", ("vllm generation --model",)),
    ("bad_fix.tf_cluster_resolver", ("tf.distribute.cluster_resolver",)),
    ("bad_fix.sequence_slice", ("sequence = [bos_id] + sequence[1:]",)),
)
GENERIC_ROOTS = ("可能由于", "可能是", "环境问题", "路径配置错误", "版本不兼容")
WEAK_STEPS = ("参考官方文档", "检查文档", "尝试在虚拟环境中重新安装", "在干净的虚拟环境中重新执行安装命令", "尝试使用浏览器手动下载", "使用在线 Jinja2 检查器", "忽略警告如果确认无影响", "torch.cuda.empty_cache()")
BAD_ADVICE = ("先导入 bitsandbytes 再导入 transformers", "GradScaler 的 init_scale 参数为较小值", "日志记录、评估步骤或未释放的中间变量导致显存逐渐累积", "优化器状态和梯度累积在反向传播后未及时释放")
GOOD_SIGNALS = ("LD_LIBRARY_PATH", "CUDA_HOME", "destroy_process_group()", "gpu_memory_utilization", "max_model_len", "dataset_info.json", "tokenizer_config.json", "hf_device_map", "sentencepiece", "ProcessGroup", "KV cache", "chat_template", "403")
CATEGORY_MAP = {"dependency": "dependency", "cuda_memory": "training", "data_format": "data", "tokenizer": "inference", "vllm": "deployment"}
BOILERPLATE = ("无附加追踪需要。", "无需附加追踪。")
PHRASES = (("彻底", ""), ("暴力", "直接"), ("黑洞", "问题"), ("灾难", "问题"), ("大屠杀式", "大规模"), ("生吞活剥", "大量"), ("斩草除根般的", ""), ("果断", ""), ("硬是", ""), ("死死", ""), ("灯下黑", "遗漏"), ("暴力改写", "调整"))
INPUT_LABELS = (("user_question", "用户问题: "), ("environment", "环境: "), ("command", "命令: "), ("log", "日志:\n"))
VIEW_SYSTEM = "你是一个训练与部署问题诊断助手。请根据输入内容输出 JSON。"
VIEW_INSTRUCTION = "请阅读下面的用户问题、环境、命令和日志，输出诊断结果 JSON。"
STRICT_SYSTEM = "你是一个训练与部署问题诊断助手。你的输出必须是严格合法的 JSON 对象。不要输出 Markdown，不要输出代码块，不要输出任何额外解释。"
STRICT_INSTRUCTION = "请阅读下面的用户问题、环境、命令和日志。只输出一个严格合法的 JSON 对象，不要添加任何额外文本。JSON 顶层必须且只能包含以下字段：category, severity, summary, root_cause, missing_info, next_steps。其中 category 只能是 dependency、training、data、inference、deployment 之一；severity 只能是 low、medium、high 之一；missing_info 和 next_steps 必须是非空数组。"
DIMENSIONS = ("evidence_groundedness", "root_cause_quality", "actionability", "missing_info_quality", "overall_engineering_quality")
JUDGE_INSTRUCTIONS = "You are an impartial evaluator for a Chinese training/deployment diagnosis assistant. Compare candidate A and candidate B for the same input. Judge only by the provided input, environment, command, and log. Prefer answers that are evidence-grounded, conservative, actionable, and helpful for engineering diagnosis. Do not reward verbosity. If both are similarly good or similarly bad, return tie. Return structured JSON only."
JUDGE_SAMPLE, JUDGE_SYSTEM, JUDGE_NO_SYSTEM, JUDGE_TASK, JUDGE_CANDIDATE = "Sample ID: ", "System prompt: ", "(none)", "Task input:", "Candidate"
JUDGE_REFERENCE = "Reference output (for calibration only, do not require exact wording match):"
WINNERS, CONFIDENCES, SCORES = ("A", "B", "tie"), ("low", "medium", "high"), (1, 2, 3, 4, 5)
RECORD_FIELDS = ("instruction", "input", "output")
SAMPLE_CODES = {
    "schema.instruction": "instruction mismatch",
    "schema.input": "input missing",
    "schema.output": "output missing",
    "schema.input.user_question": "bad input.user_question",
    "schema.input.environment": "bad input.environment",
    "schema.input.command": "bad input.command",
    "schema.input.log": "bad input.log",
    "schema.output.category": "bad category",
    "schema.output.severity": "bad severity",
    "schema.output.summary": "bad output.summary",
    "schema.output.root_cause": "bad output.root_cause",
    "schema.output.missing_info": "bad output.missing_info",
    "schema.output.next_steps": "bad output.next_steps",
}
MATRICES = ("default_prompt", "strict_json_prompt", "both", "qwen25_3b_default_prompt", "qwen25_3b_strict_json_prompt", "qwen3_4b_default_prompt", "qwen3_4b_strict_json_prompt")
DEVICES = {"cuda:0": 0, "cpu": "cpu"}
EXPANSION_SYSTEM = """你是一名负责构造训练数据的工程师。

任务：
1. 参考给定 seed 样本，为每条 seed 扩写出若干条“同类型但不重复”的新样本。
2. 输出必须是严格 JSON，且只能输出 JSON，不要添加解释。
3. 输出的每条样本必须保持与 seed 相同的 schema：
   - instruction
   - input.user_question
   - input.environment
   - input.command
   - input.log
   - output.category
   - output.severity
   - output.summary
   - output.root_cause
   - output.missing_info
   - output.next_steps
4. output.category 只能是以下之一：
   - dependency
   - training
   - data
   - inference
   - deployment
5. output.severity 只能是 low、medium、high。
6. output.missing_info 和 output.next_steps 必须是非空数组。
7. 不要照抄 seed，必须改写环境、命令、日志细节、提问方式或信息完整度。
8. 不要引入明显超出日志证据的强结论，风格要克制、工程化、可执行。
9. 尽量生成与单卡训练、推理部署、常见依赖问题相关的样本，避免过于小众的硬件或特殊框架。

输出格式：
{
  "generated": [
    {
      "seed_id": 1,
      "samples": [ ... ]
    }
  ]
}
"""
EXPANSION_TASK = "请为每条 seed 扩写 {n} 条新样本。"
EXPANSION_REQUIREMENTS = ("保持同一任务类型和同一输出 schema。", "可以改写环境、命令、日志、用户描述方式和缺失信息，但不要直接复制 seed。", "output.category 与 seed 保持一致或保持在同一问题域内。", "next_steps 要具体、保守、可执行。", "missing_info 要体现继续排查时真正需要的上下文。")
KEPT_SEEDS = (1, 3, 6, 7, 10, 11, 12, 13, 15, 16, 17, 20, 21, 23, 25, 26, 29, 34, 35, 39, 40, 41, 42, 43, 44, 45, 46, 47, 48, 49)
# What is filled in where a record says nothing, by category; "training/oom" where the log speaks of memory.
MISSING_INFO = {
    "dependency": ("完整的安装命令和报错上下文。",),
    "dependency/no version": ("相关库的准确版本号。", "完整的安装命令和报错上下文。"),
    "training": ("分布式配置、节点数和 GPU 数量。", "出错前最后一段完整日志。"),
    "training/oom": ("训练时的 batch size、序列长度和精度设置。", "是否启用了 gradient checkpointing、LoRA 或量化加载。"),
    "data": ("一条最小可复现的数据样本。", "预处理脚本或数据集配置片段。"),
    "inference": ("使用的模型名和 tokenizer 版本。", "触发报错的最小输入样例。"),
    "deployment": ("启动命令和关键环境变量。", "宿主机驱动、CUDA 和容器镜像版本。"),
}
NEXT_STEPS = {
    "dependency": ("核对 Python、PyTorch、CUDA 与相关扩展的版本组合是否兼容。", "在干净虚拟环境中复现，并保留完整安装日志。", "优先使用项目文档中明确支持的版本或预编译 wheel。"),
    "training": ("保留完整分布式日志，先确认是哪一个 rank 先报错或卡住。", "检查网络、NCCL 相关环境变量和节点间连通性。", "用更小的数据或单卡配置复现，缩小问题范围。"),
    "training/oom": ("降低 batch size 或 max sequence length，并确认使用了合适的量化或 LoRA 配置。", "检查是否启用了 gradient checkpointing、flash attention 或其他显存优化手段。", "记录出错前后的显存占用，判断是峰值过高还是碎片化问题。"),
    "data": ("抽取一条最小样本单独跑预处理，先确认字段和编码是否符合预期。", "对数据集做 schema、编码和长度校验，避免脏样本进入训练。", "必要时降低并行处理数，确认问题不是由多进程放大的。"),
    "inference": ("确认模型、tokenizer 和 chat template 来自同一版本或同一仓库。", "先用最小输入复现，再检查模板、特殊 token 和返回参数是否匹配。", "如果是离线环境，确认所需的 tokenizer 或模板文件已经完整下载。"),
    "deployment": ("先核对驱动、CUDA、容器镜像和 vLLM 版本是否在支持矩阵内。", "用最小启动参数复现，再逐步加回显存利用率或并发配置。", "保留完整启动日志，重点检查 GPU 初始化、模板解析和内核编译相关报错。"),
}
SUMMARIES = {
    "dependency": "依赖版本或二进制兼容性问题导致组件无法正常加载。",
    "training": "训练过程中的运行时配置或分布式通信异常导致任务失败。",
    "training/oom": "训练过程出现显存不足，导致作业中断。",
    "data": "数据格式或预处理流程异常导致样本无法被正确读取。",
    "inference": "推理前处理或模板配置异常导致输入无法正常解析。",
    "deployment": "部署或服务启动配置异常导致推理服务无法正常运行。",
}
ROOT_CAUSES = {
    "dependency": "当前环境中的依赖版本、CUDA 组件或预编译扩展与目标库不兼容。",
    "training": "训练配置、显存预算或分布式运行条件与当前任务不匹配。",
    "data": "数据内容、编码或字段结构与预处理逻辑的假设不一致。",
    "inference": "tokenizer、chat template 或推理前处理参数之间存在不匹配。",
    "deployment": "驱动、CUDA、容器或服务配置之间存在版本或运行时不兼容。",
}


@dataclass(frozen=True)
class RecordContract:
    """Fields of a record's input and output, their kinds and allowed values."""

    instruction: str
    inputs: tuple[str, ...]
    enums: dict[str, tuple[str, ...]]
    texts: tuple[str, ...]
    lists: tuple[str, ...]
    deny: tuple[tuple[str, tuple[str, ...]], ...] = field(default=())

    @property
    def outputs(self) -> tuple[str, ...]:
        return (*self.enums, *self.texts, *self.lists)


DIAGNOSIS = RecordContract(INSTRUCTION, ("user_question", "environment", "command", "log"), {"category": CATEGORIES, "severity": SEVERITIES}, ("summary", "root_cause"), ("missing_info", "next_steps"), DENY_LIST)
RECORD_DDL = "instruction string, input struct<user_question:string, environment:string, command:string, log:string>, output struct<category:string, severity:string, summary:string, root_cause:string, missing_info:array<string>, next_steps:array<string>>"
