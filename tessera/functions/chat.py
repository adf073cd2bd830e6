"""Conversations as text: role blocks, their parsing, and the template registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import normalize_text, strip

# The markers and role names of the role-block format.
BEGIN, END = "<|beginofutterance|>", "<|endofutterance|>"
SYSTEM, USER, ASSISTANT = "系统", "用户", "智能助手"
ROLES = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}

CONVERSATION = "array<struct<human:string,assistant:string>>"


def chatml(system: Column, user: Column, assistant: Column, stripped: bool = True) -> Column:
    """Three role blocks, empty ones too."""
    part = strip if stripped else lambda c: c
    block = lambda role, c, tail: F.concat(F.lit(f"{BEGIN}{role}\n"), part(c), F.lit(f"\n{END}{tail}"))
    return F.concat(block(SYSTEM, system, "\n"), block(USER, user, "\n"), block(ASSISTANT, assistant, ""))


def parse_by_position(c: Column) -> Column:
    """(instruction, input, output) of the first three blocks whatever their roles; null with fewer."""
    parts = F.split(c, rf"(?:\Q{BEGIN}\E)(?:{SYSTEM}|{USER}|{ASSISTANT})\n", -1)
    body = lambda i: normalize_text(strip(F.substring_index(F.element_at(parts, i), END, 1)))
    return F.when(F.size(parts) >= 4, F.struct(body(2).alias("instruction"), body(3).alias("input"), body(4).alias("output")))


def first_of_role(c: Column, role: str) -> Column:
    """The body of a role's first block; null if there is none."""
    body = F.regexp_extract_all(c, F.lit(rf"(?s)\Q{BEGIN}{role}\E\s*\n(.*?)\Q{END}\E"), F.lit(1))
    return strip(F.try_element_at(body, F.lit(1)))


def parse_by_role(c: Column) -> Column:
    """(user, assistant): the first block of each role; the user's falls back to the system's; null without an assistant."""
    user = F.coalesce(F.nullif(first_of_role(c, USER), F.lit("")), F.nullif(first_of_role(c, SYSTEM), F.lit("")))
    assistant = F.nullif(first_of_role(c, ASSISTANT), F.lit(""))
    return F.when(user.isNotNull() & assistant.isNotNull(), F.struct(user.alias("user"), assistant.alias("assistant")))


def triplet(input: Column, output: Column) -> Column:
    """(user, assistant) of a record that has both fields, empty ones too."""
    return F.when(input.isNotNull() & output.isNotNull(), F.struct(input.alias("user"), output.alias("assistant")))


def conversation(pair: Column) -> Column:
    return F.when(pair.isNotNull(), F.array(F.struct(pair["user"].alias("human"), pair["assistant"].alias("assistant"))))


ABOUT_INTERNLM = (
    "You are an AI assistant whose name is InternLM (书生·浦语).\n"
    "- InternLM (书生·浦语) is a conversational language model that is developed by Shanghai AI Laboratory (上海人工智能实验室). It is designed to be helpful, honest, and harmless.\n"
    "- InternLM (书生·浦语) can understand and communicate fluently in the language chosen by the user such as English and 中文."
)
ABOUT_LLAMA2 = (
    "You are a helpful, respectful and honest assistant. Always answer as helpfully as possible, while being safe. "
    "Your answers should not include any harmful, unethical, racist, sexist, toxic, dangerous, or illegal content. "
    "Please ensure that your responses are socially unbiased and positive in nature.\n\n"
    "If a question does not make any sense, or is not factually coherent, explain why instead of answering something not correct. "
    "If you don't know the answer to a question, please don't share false information."
)
ABOUT_VICUNA = "A chat between a curious user and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite answers to the user's questions."
ABOUT_GLM3 = "You are ChatGLM3, a large language model trained by Zhipu.AI. Follow the user's instructions carefully. Respond using markdown."
HELPFUL = "You are a helpful assistant."
IM_SYSTEM, IM_USER, IM_ANSWER = "<|im_start|>system\n{content}<|im_end|>\n", "<|im_start|>user\n{content}<|im_end|>\n<|im_start|>assistant\n", "{content}<|im_end|>\n"

# Chat formats of public models: name, system, user, assistant, default system text, stop word.
TEMPLATES = [
    ("default", "System: {content}\n\n", "User: {content}\nAssistant: ", "{content} {stop_token}", None, None),
    ("internlm", "<|System|>:{content}\n", "<|User|>:{content}\n<|Bot|>:", "{content}</s>\n", ABOUT_INTERNLM, "</s>"),
    ("internlm2", IM_SYSTEM, IM_USER, IM_ANSWER, ABOUT_INTERNLM, "<|im_end|>"),
    ("qwen", IM_SYSTEM, IM_USER, IM_ANSWER, HELPFUL, "<|im_end|>"),
    ("yi", IM_SYSTEM, IM_USER, IM_ANSWER, None, "<|im_end|>"),
    ("orion", "<s>", "Human: {content}\n\nAssistant: </s>", "{content}</s>", "", "</s>"),
    ("deepseek", None, "User: {content}\n\nAssistant: ", "{content}<｜end▁of▁sentence｜>", None, "<｜end▁of▁sentence｜>"),
    ("chatglm2", None, "[Round {idx}]\n\n问：{content}\n\n答：", "{content}", None, "</s>"),
    ("chatglm3", "{content}", "{content}", "{content}", ABOUT_GLM3, "</s>"),
    ("ziya2", None, "<human>:{content} <bot>:", "{content}</s>", None, "</s>"),
    ("xverse", None, "Human: {content}\n\nAssistant: ", "{content}<|endoftext|>", None, "<|endoftext|>"),
    ("minicpm", None, "<用户>{content}<AI>", "{content}</s>", None, "</s>"),
    ("minicpm3", IM_SYSTEM, IM_USER, IM_ANSWER, HELPFUL, "<|im_end|>"),
    ("minicpm4", IM_SYSTEM, IM_USER, IM_ANSWER, HELPFUL, "<|im_end|>"),
    ("zephyr", "<|system|>\n{content}</s>", "<|user|>\n{content}</s>\n<|assistant|>\n", "{content}</s>\n", None, "</s>"),
    ("mistral", "<s>", "[INST]{content}[/INST]", "{content}</s>", "", "</s>"),
    ("mixtral", "<s>", "[INST]{content}[/INST]", "{content}</s>", "", "</s>"),
    ("baichuan", None, "<reserved_102>{content}<reserved_103>", "{content}</s>", None, "</s>"),
    ("baichuan2", None, "<reserved_106>{content}<reserved_107>", "{content}</s>", None, "</s>"),
    ("vicuna", "{content}\n", "USER: {content} ASSISTANT:", "{content}</s>", ABOUT_VICUNA, "</s>"),
    ("llama2", "<<SYS>>\n{content}\n<</SYS>>\n\n", "[INST]{content}[/INST]", "{content} </s>", ABOUT_LLAMA2, "</s>"),
    ("llama3", "<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\n{content}<|eot_id|>", "<|start_header_id|>user<|end_header_id|>\n\n{content}<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n", "{content}<|eot_id|>", None, "<|eot_id|>"),
    ("gemma", "<bos>", "<start_of_turn>user\n{content}<end_of_turn>\n<start_of_turn>model\n", "{content}<eos>\n", "", "<eos>"),
    ("phi3", None, "<|user|>\n{content}<|end|>\n<|assistant|>", "{content}<|end|>\n", None, "<|end|>"),
]
TEMPLATE_SCHEMA = "template_name string, system_format string, user_format string, assistant_format string, default_system string, stop_word string"


def templates(spark: SparkSession, more: list[tuple] = ()) -> DataFrame:
    """The registry as a table; later entries of a name win."""
    return spark.createDataFrame(list({t[0]: t for t in [*TEMPLATES, *more]}.values()), TEMPLATE_SCHEMA)


def filled(fmt: Column, content: Column, **more: Column) -> Column:
    out = fmt
    for name, c in more.items():
        out = F.replace(out, F.lit(f"{{{name}}}"), c)
    return F.replace(out, F.lit("{content}"), content)


def render(turns: Column, system: Column, stop_token: str = "</s>") -> Column:
    """A conversation by its template's columns: system if its format and text exist, then each stripped turn; rounds count from 1."""
    head = F.when(F.col("system_format").isNotNull() & system.isNotNull(), filled(F.col("system_format"), system)).otherwise(F.lit(""))

    def turn(t: Column, i: Column) -> Column:
        asked = filled(F.col("user_format"), strip(t["human"]), idx=(i + 1).cast("string"), stop_token=F.lit(stop_token))
        return F.concat(asked, filled(F.col("assistant_format"), strip(t["assistant"]), stop_token=F.lit(stop_token)))

    return F.concat(head, F.array_join(F.transform(turns, turn), ""))


# How servers separate the turns of a conversation: opening of a turn, its end, and what an empty turn leaves.
STYLES = {
    "colon": ("{role}: ", "{sep}", "{role}:"),
    "colon_space": ("{role}: ", "{sep}", "{role}: "),
    "newline": ("{role}\n", "{sep}", "{role}\n"),
    "no_colon": ("{role}", "{sep}", "{role}"),
    "header": ("<|start_header_id|>{role}<|end_header_id|>\n\n", "<|eot_id|>", "<|start_header_id|>{role}<|end_header_id|>\n\n"),
    "short_header": ("<|header_start|>{role}<|header_end|>\n\n", "<|eot|>", "<|header_start|>{role}<|header_end|>\n\n"),
}


def prompt(system: Column, messages: Column, style: str, sep: str = "\n", sep2: str | None = None) -> Column:
    """A prompt of messages (role, text) in a separator style; seps alternate if there are two. An empty message leaves its role's header open."""
    opening, end, empty = STYLES[style]
    trims = style.endswith("header")

    def one(m: Column, i: Column) -> Column:
        fill = lambda s: F.replace(F.lit(s), F.lit("{role}"), m["role"])
        gap = F.lit(sep) if sep2 is None else F.when(i % 2 == 0, sep).otherwise(sep2)
        text = strip(m["text"]) if trims else m["text"]
        closing = gap if end == "{sep}" else F.lit(end)
        return F.when(F.coalesce(F.length(m["text"]), F.lit(0)) > 0, F.concat(fill(opening), text, closing)).otherwise(fill(empty))

    lead = system if style in ("no_colon", "header", "short_header") else F.concat(system, F.lit(sep))
    if style == "newline":
        lead = F.when(system == "", F.lit("")).otherwise(lead)
    return F.concat(lead, F.array_join(F.transform(messages, one), ""))


def openai_messages(system: Column, texts: Column) -> Column:
    """[system, user, assistant, …]: even places are the user's."""
    said = F.transform(texts, lambda t, i: F.struct(F.when(i % 2 == 0, "user").otherwise("assistant").alias("role"), t.alias("content")))
    return F.concat(F.when(system != "", F.array(F.struct(F.lit("system").alias("role"), system.alias("content")))).otherwise(F.array().cast("array<struct<role:string,content:string>>")), said)
