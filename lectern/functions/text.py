"""Column functions on text: tokens, keywords, names, hashes, error classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
TOKEN = r"[一-鿿A-Za-z0-9_]+"
KEYWORD = r"[一-鿿A-Za-z][一-鿿A-Za-z0-9_-]{2,20}"
HEADING = r"(?iUd)^\s*((第[一二三四五六七八九十百\d]+[章节篇])|(\d+(?:\.\d+){0,3})|(chapter\s+\d+))[\s:：、.-]*(.*)$"
BLANK_LINES = r"(?U)\n\s*\n|\r\n\s*\r\n"
FINISHED = ("stop", "end_turn", "tool_calls")


def strip(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def filled(text: Column) -> Column:
    """Null where the text is empty."""
    return F.nullif(text, F.lit(""))


def hash_tokens(text: Column) -> Column:
    """Lower-case runs of word characters, in order, with repeats."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def keywords(text: Column, most: int = 10) -> Column:
    """The first distinct keywords in order of appearance."""
    return F.slice(F.array_distinct(F.regexp_extract_all(text, F.lit(KEYWORD), F.lit(0))), 1, most)


def first_distinct(tokens: Column, most: int) -> Column:
    """The first distinct members of an array in order of appearance."""
    return F.slice(F.array_distinct(tokens), 1, most)


def heading(paragraph: Column) -> Column:
    """The token of a heading that fills the paragraph; empty if it is none."""
    return F.regexp_extract(paragraph, HEADING, 1)


def paragraphs(text: Column, size: int = 1000, overlap: int = 150) -> Column:
    """Stripped paragraphs between blank lines; longer ones than ``size`` as windows that begin every size - overlap characters."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    parts = F.filter(F.transform(F.split(text, BLANK_LINES), strip), lambda p: p != "")
    step = size - overlap
    windows = lambda p: F.transform(F.sequence(F.lit(1), F.length(p), F.lit(step)), lambda i: F.substring(p, i, F.lit(size)))
    return F.flatten(F.transform(parts, lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(windows(p))))


def collection_name(course: Column, prefix: str = "course_") -> Column:
    """A store name of at most 63 characters."""
    return F.left(F.concat(F.lit(prefix), F.regexp_replace(course, "[^A-Za-z0-9_-]", "_")), F.lit(63))


def text_sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def prompt_hash(prompt: Column, policy: str = "") -> Column:
    """Digest of the stripped prompt, with the policy block behind a blank line if there is one."""
    return F.sha2(F.concat(strip(prompt), F.lit(f"\n\n{policy}")) if policy else strip(prompt), 256)


def request_hash(payload_json: Column) -> Column:
    """Digest of canonical JSON: sorted keys, no spaces, nulls kept.  Numbers take their shortest form (1.0 becomes 1)."""
    return F.sha2(F.to_json(F.parse_json(payload_json)), 256)


def fingerprint(identity_json: Column, ignored: tuple[str, ...] = ()) -> Column:
    """Digest of canonical JSON of an object without the ignored top-level keys; only good for comparison."""
    members = F.from_json(identity_json, "map<string,string>")
    kept = F.map_filter(members, lambda k, _: ~k.isin(*ignored)) if ignored else members
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(kept)))), 256)


def step_key(run: Column, step: Column, prefix: str = "eval") -> Column:
    return F.concat_ws(":", F.lit(prefix), run, F.left(F.sha2(step, 256), F.lit(32)))


def valid_key(key: Column) -> Column:
    """Whether a request key has 1 to 255 characters when stripped."""
    return F.length(strip(key)).between(1, 255)


def slug(text: Column) -> Column:
    """Runs of anything but word characters, CJK and - as one _, none at the ends, at most 80 characters; null gives empty."""
    words = F.regexp_replace(strip(text), r"(?U)[^\w一-鿿-]+", "_")
    return F.coalesce(F.left(F.regexp_replace(F.regexp_replace(words, "_+", "_"), "^_+|_+$", ""), F.lit(80)), F.lit(""))


def export_name(course: Column, topic: Column, role: Column, unique_id: Column, extension: str) -> Column:
    """course_topic_role_id.ext of the parts that have a slug."""
    stem = F.concat_ws("_", *[filled(slug(c)) for c in (course, topic, role)])
    short = F.coalesce(filled(F.left(slug(unique_id), F.lit(8))), F.lit("export"))
    return F.concat(stem, F.lit("_"), short, F.lit(f".{extension.removeprefix('.')}"))


def target_session(scope: Column, sessions: Column) -> Column:
    """Index of the session that the first number in a text names; 0 if it names none."""
    index = filled(F.regexp_extract(scope, "([0-9]{1,9})", 1)).cast("int") - 1
    return F.coalesce(F.when(index.between(0, sessions - 1), index), F.lit(0))


def normal_judgement(answer: Column) -> Column:
    """true or false in lower case, 正确 and 错误 as they are, else null."""
    bare = strip(answer)
    # The answers.
    return F.when(F.lower(bare).isin("true", "false"), F.lower(bare)).when(bare.isin("正确", "错误"), bare)


def split_answers(answer: Column) -> Column:
    """The distinct stripped members of a comma list, without empty ones."""
    return F.array_distinct(F.filter(F.transform(F.split(answer, ","), strip), lambda x: x != ""))


def source_type_for(path: Column) -> Column:
    low = F.lower(path)
    return F.when(low.endswith(".xlsx"), "knowledge_graph").when(low.endswith(".docx"), "textbook").otherwise("unknown")


def suffix(path: Column) -> Column:
    """The last suffix of a file's name with its dot, in lower case; empty if it has none."""
    return F.regexp_extract(F.lower(path), r"[^/.](\.[^./]+)$", 1)


def contains_all_terms(content: Column, terms: Column) -> Column:
    """Whether each term occurs in the content, whatever the case; no terms: true."""
    return F.forall(F.coalesce(terms, F.array().cast("array<string>")), lambda t: F.contains(F.lower(content), F.lower(t)))


def error_category(kind: Column, module: Column, message: Column, validation: Column | None = None) -> Column:
    """The class of a failed call, by ordered rules on the exception's class name, module and message."""
    # The tokens looked for and the classes.
    name, module, message = (F.lower(F.coalesce(c, F.lit(""))) for c in (kind, module, message))
    has = lambda c, *tokens: reduce(lambda a, b: a | b, [F.contains(c, F.lit(t)) for t in tokens])
    is_validation = name == "validationerror" if validation is None else validation
    return (
        F.when(has(name, "timeout") | has(message, "timeout", "timed out"), "timeout")
        .when(has(message, "choices") & has(message, "none"), "choices_none")
        .when(is_validation, "pydantic_validation_error")
        .when(has(name, "parsing") | has(message, "parse", "json"), "structured_parse_error")
        .when(has(message, "finish_reason", "interrupted", "content_filter", "incomplete"), "generation_interrupted")
        .when(has(module, "openai") | has(name, "api", "rate"), "llm_provider_error")
        .otherwise("unknown_llm_error")
    )


def interrupted(finish_reason: Column) -> Column:
    """Whether a call ended for another reason than being done."""
    reason = F.lower(F.coalesce(finish_reason, F.lit("")))
    return (reason != "") & ~reason.isin(*FINISHED)


def token_estimate(text: Column) -> Column:
    """Tokens taken as half the characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 2)).cast("long")


def resolve_usage(usage_json: Column, prompt: Column, output: Column) -> Column:
    """Struct (input_tokens, output_tokens, total_tokens, usage_source): what the provider says under either naming, else an estimate."""
    get = lambda *names: F.coalesce(*[F.get_json_object(usage_json, f"$.{n}").cast("long") for n in names])
    given, made = get("input_tokens", "prompt_tokens"), get("output_tokens", "completion_tokens")
    known = usage_json.isNotNull() & ~F.trim(usage_json).isin("", "{}", "null")
    zero = F.lit(0).cast("long")
    said = F.struct(F.coalesce(given, zero).alias("input_tokens"), F.coalesce(made, zero).alias("output_tokens"), F.coalesce(get("total_tokens"), given + made, zero).alias("total_tokens"), F.lit("provider").alias("usage_source"))
    a, b = token_estimate(F.coalesce(prompt, F.lit(""))), token_estimate(F.coalesce(output, F.lit("")))
    guess = F.struct(a.alias("input_tokens"), b.alias("output_tokens"), (a + b).alias("total_tokens"), F.lit("estimate").alias("usage_source"))
    return F.when(known, said).otherwise(guess)


def message_text(turns: Column) -> Column:
    """role: content lines from an array of (turn, role, content), by turn."""
    return F.array_join(F.transform(F.array_sort(turns), lambda t: F.concat(t["role"], F.lit(": "), t["content"])), "\n")


def latency_ms(start: Column, end: Column) -> Column:
    """Whole milliseconds between two timestamps."""
    return F.floor((F.unix_micros(end) - F.unix_micros(start)) / 1000).cast("long")


def lease_deadline(now: Column, seconds: int) -> Column:
    return now + F.make_interval(secs=F.lit(seconds))


def is_future(deadline: Column, now: Column) -> Column:
    return F.coalesce(deadline > now, F.lit(False))


def time_allocation(duration: Column) -> Column:
    """Array of (activity, minutes) for a session."""
    intro, practice = F.greatest(F.lit(5), F.floor(duration / 9)).cast("int"), F.greatest(F.lit(5), F.floor(duration / 4)).cast("int")
    # The activities.
    parts = (("导入与目标说明", intro), ("核心概念讲解", duration - intro - practice - 5), ("课堂练习与互动", practice), ("总结与作业说明", F.lit(5)))
    return F.array(*[F.struct(F.lit(a).alias("activity"), m.cast("int").alias("minutes")) for a, m in parts])


def slice_points(points: Column, index: Column, total: Column) -> Column:
    """A session's share of the points: at most 5, the last session takes the rest, the first point if nothing is left."""
    bucket = F.greatest(F.lit(1), F.floor(F.size(points) / total)).cast("int")
    start = (index - 1) * bucket
    count = F.when(index == total, F.size(points) - start).otherwise(bucket)
    share = F.slice(points, start + 1, F.least(F.greatest(count, F.lit(0)), F.lit(5)))
    return F.when(F.size(share) > 0, share).otherwise(F.slice(points, 1, 1))


def dominant(entries: Column) -> Column:
    """The key with the largest value of an array of (pos, key, value); the first of equals; medium if there is none."""
    best = F.array_max(F.transform(entries, lambda e: F.struct(e["value"].alias("v"), (-e["pos"]).alias("p"), e["key"].alias("k"))))
    return F.coalesce(best["k"], F.lit("medium"))
