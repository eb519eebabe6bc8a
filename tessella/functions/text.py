"""Column functions over text: cleaning, counting, query analysis, redaction, formatting."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists, categories and patterns that decide results.
QUESTION_WORDS = ["什么", "怎么", "如何", "为什么", "哪个", "哪些", "是否", "能否", "多少", "谁", "何时"]
CONJUNCTIONS = ["并且", "而且", "另外", "同时", "以及", "还有", "然后"]
URL_CATEGORIES = [
    (["规则", "制度", "法律", "审核"], "规则类"),
    (["使用", "指南", "帮助", "操作", "功能"], "操作类"),
    (["生态", "角色", "策略", "推广", "平台信息"], "信息类"),
]
OTHER_CATEGORY = "泛用类"
REWRITE_SKIP = [
    "你好", "您好", "hi", "hello", "哈喽", "在吗", "喂", "请问在吗", "有人吗", "hello？",
    "你是谁", "你是人吗", "你是机器人吗", "你是AI吗", "你叫什么", "你是客服吗",
    "你是智能助手吗", "你是人工的吗", "你能听懂我说话吗",
    "呵呵", "哈哈", "嗯", "哼", "额", "好吧", "无语", "。。。", "...", "===",
    "你猜", "随便", "看你咋说",
    "测试", "test", "just testing", "随便问问", "这是个测试", "debug", "看看你怎么回答",
    "今天是几号", "时间", "天气", "北京天气", "今天天气", "讲个笑话", "背首诗",
    "给我唱首歌", "来段rap",
    "重启一下", "清除缓存", "退出系统", "保存文件", "打开浏览器", "运行代码",
    "执行脚本", "回答问题",
    "你扮演谁", "假设你是", "你是人类", "如果你是我", "从你的角度看", "你作为一个AI",
    "存在的意义是什么", "人生的意义", "什么是真实", "你怎么看这个世界", "你觉得我是谁",
    "商品", "服务", "平台", "抖音", "小红书", "视频", "规则", "政策", "报表",
]
UI_NOISE = r"(?i)^(\d+%|PROGRESS|CONTENTS|尚未开始|目录|↑顶部|搜索\.\.\.|←上一页|下一页→)$"
TOKEN = r"[一-鿿]|[A-Za-z0-9]+"
SENTENCE_BREAK = r"[。！？；，,.!?;:、\n\r]+"
INVISIBLE = r"[\u200b-\u200f\u202a-\u202e\u2060-\u206f]"
HTML_TAG = r"</?[a-zA-Z][a-zA-Z0-9]*(?:\s[^>]*)?>"
CITATION = r"\[(\d+)\]"
# End of fixed values.


def filled(c: Column) -> Column:
    """Null as the empty text."""
    return F.coalesce(c, F.lit(""))


def stripped(c: Column) -> Column:
    """White space off both ends, all of Unicode's."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def any_of(c: Column, words: list[str]) -> Column:
    """Whether one of the words occurs."""
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(c, F.lit(w))
    return hit


def chars_or_words(c: Column, by_char: bool) -> Column:
    """Length of the text, or its words between white space."""
    return F.length(filled(c)) if by_char else F.size(F.filter(F.split(filled(c), r"\s+"), lambda x: x != ""))


def dense_chars(c: Column) -> Column:
    """Characters that are not white space."""
    return F.length(F.regexp_replace(filled(c), r"\s", ""))


def clean_text(c: Column) -> Column:
    """Only CJK ideographs up to U+9FA5, ASCII letters and digits, run together."""
    return F.regexp_replace(filled(c), "[^一-龥a-zA-Z0-9]", "")


def clean_invisible(c: Column) -> Column:
    return F.regexp_replace(filled(c), INVISIBLE, "")


def all_ideographs(c: Column) -> Column:
    """Whether a text is one or more CJK ideographs and nothing else."""
    return F.rlike(filled(c), F.lit("^[一-鿿]+$"))


def token_pair(question: Column, document: Column, most: int) -> tuple[Column, Column]:
    """Both cut to their first tokens, a half of ``most`` for the question and the rest for the document."""
    half = most // 2
    return F.array_join(F.slice(tokens(question), 1, half), " "), F.array_join(F.slice(tokens(document), 1, most - half), " ")


def is_ui_noise(c: Column) -> Column:
    return F.rlike(F.trim(filled(c)), F.lit(UI_NOISE))


def clean_title(c: Column, most: int = 48) -> Column:
    return F.substring(F.trim(F.regexp_replace(filled(c), r"^[0-9.]+\s*", "")), 1, most)


def tokens(c: Column) -> Column:
    """Single ideographs, and runs of ASCII letters and digits; case is kept."""
    return F.regexp_extract_all(filled(c), F.lit(f"({TOKEN})"), 1)


def time_tag(c: Column) -> tuple[Column, Column]:
    """The leading time element's text, and the page without it."""
    lead = r"(?is)^\s*<time[^>]*?>(.*?)</time>"
    return F.trim(F.regexp_extract(filled(c), lead, 1)), F.when(F.rlike(filled(c), F.lit(lead)), F.ltrim(F.regexp_replace(filled(c), lead, ""))).otherwise(filled(c))


def drop_placeholders(c: Column) -> Column:
    return F.regexp_replace(filled(c), r"(?i)\{\{[^}]*PLACEHOLDER[^}]*\}\}", "")


def clean_xml(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(filled(c), r"<\?xml.*?>", ""), r"(?i)<!DOCTYPE.*?>", "")


def tidy_html(c: Column) -> Column:
    out = filled(c)
    for pattern, to in ((r"```html\s*", ""), (r"```", ""), (r">\s*\n\s*<", "><"), (r">\s+\n", ">\n"), (r"\n{3,}", "\n\n")):
        out = F.regexp_replace(out, pattern, to)
    return stripped(out)


def language(c: Column) -> Column:
    cjk, latin = F.rlike(filled(c), F.lit("[一-鿿]")), F.rlike(filled(c), F.lit("[A-Za-z]"))
    return F.when(cjk & latin, "mixed").when(cjk, "zh").when(latin, "en").otherwise("unknown")


def is_question(c: Column) -> Column:
    q = F.trim(filled(c))
    return q.endswith("?") | q.endswith("？") | any_of(q, QUESTION_WORDS)


def complexity(c: Column) -> Column:
    q = F.trim(filled(c))
    return F.when(any_of(q, CONJUNCTIONS) | (F.length(q) > 40), "complex").otherwise("simple")


def keywords(c: Column, most: int = 8) -> Column:
    """Distinct tokens of two characters or more, longest first, then in order."""
    long = F.array_distinct(F.filter(tokens(c), lambda t: F.length(t) > 1))
    ranked = F.array_sort(F.transform(long, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    return F.slice(F.transform(ranked, lambda s: s["t"]), 1, most)


def url_category(c: Column) -> Column:
    out = F.lit(OTHER_CATEGORY)
    for words, name in reversed(URL_CATEGORIES):
        out = F.when(any_of(filled(c), words), name).otherwise(out)
    return out


def skip_rewrite(query: Column, turns: Column) -> Column:
    return query.isin(REWRITE_SKIP) | (turns < 2)


def after_thinking(c: Column) -> Column:
    return F.trim(F.substring_index(filled(c), "</think>", -1))


def redact(c: Column) -> Column:
    """API keys, bearer tokens and users' folders out of a text or a JSON string."""
    out = F.regexp_replace(filled(c), "sk-[a-zA-Z0-9]+", "sk-***")
    out = F.regexp_replace(out, r"Bearer\s+[a-zA-Z0-9_\-]+", "Bearer ***")
    return F.regexp_replace(out, r"(/Users/|/home/|C:\\Users\\)[^/\\]+", "$1***")


def token_estimate(c: Column) -> Column:
    return F.floor(F.length(filled(c)) / 4).cast("long")


def date_time(c: Column) -> Column:
    """A time as year-month-day hour:minute:second; years after 9999 have no sign before them."""
    return F.regexp_replace(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), r"^\+", "")


def file_name(c: Column, most: int = 120) -> Column:
    out = F.regexp_replace(filled(c), r'[\\/:*?"<>|]', "_")
    return F.substring(F.regexp_replace(out, r"^[ .]+|[ .]+$", ""), 1, most)


def summary(c: Column, most: int = 150) -> Column:
    """The fallback summary of a text: its head."""
    t = filled(c)
    return F.when(F.length(t) < 2 * most, F.left(t, F.lit(most))).otherwise(F.left(F.trim(F.replace(t, F.lit("\0"), F.lit(""))), F.lit(most)))


def content_hash(c: Column) -> Column:
    return F.substring(F.sha2(filled(c), 256), 1, 16)


def file_size(n: Column) -> Column:
    """B to TB with one decimal."""
    out = F.format_string("%.1fTB", F.bround(n / 1024.0**4, 1))
    for power, unit in reversed(list(enumerate(["B", "KB", "MB", "GB"]))):
        out = F.when(n < 1024 ** (power + 1), F.format_string(f"%.1f{unit}", F.bround(n / 1024.0**power, 1))).otherwise(out)
    return out


def cited(c: Column) -> Column:
    """Distinct citation numbers of an answer, ascending."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(filled(c), F.lit(CITATION), 1), lambda x: x.cast("int"))))


def labelled_document(page: Column, title: Column, url: Column, summary: Column, text: Column) -> Column:
    """The five labelled lines that a reranker reads."""
    names = ["【页面名称】：", "【段落标题】：", "【来源路径】：", "【摘要】：", "【正文】："]
    return F.concat_ws("\n", *(F.concat(F.lit(n), F.trim(filled(c))) for n, c in zip(names, (page, title, url, summary, text))))


def rerank_text(title: Column, summary: Column, text: Column, most: int = 2000) -> Column:
    return F.substring(F.concat_ws("\n", *(F.nullif(filled(c), F.lit("")) for c in (title, summary, text))), 1, most)


def relevance_labels(answer: Column, n: int) -> Column:
    """The labels 0, 1 or 2 of n documents, or null where one is missing."""
    each = F.array(*(F.nullif(F.regexp_extract(filled(answer), rf"文档{i}\s*[:：]\s*([012])", 1), F.lit("")).cast("int") for i in range(1, n + 1)))
    return F.when(F.forall(each, lambda x: x.isNotNull()), each)


def truncate_lines(c: Column, lines: int = 2000, size: int = 51200, how: str = "head") -> Column:
    """Texts over the limits cut to their first, last, or first and last lines."""
    parts = F.split(filled(c), "\n")
    n = F.size(parts)
    half = lines // 2
    cut = {
        "head": F.slice(parts, 1, lines),
        "tail": F.slice(parts, F.greatest(n - lines + 1, F.lit(1)), F.lit(lines)),
        "head_tail": F.when(n <= lines, parts).otherwise(F.concat(F.slice(parts, 1, half), F.array(F.lit("...")), F.slice(parts, F.greatest(n - (lines - half) + 1, F.lit(1)), F.lit(lines - half)))),
    }[how]
    return F.when((n <= lines) & (F.octet_length(filled(c)) <= size), filled(c)).otherwise(F.array_join(cut, "\n"))


def front_matter(c: Column) -> tuple[Column, Column]:
    """Name and description of a leading front-matter block, null where it is missing."""
    block = F.regexp_extract(filled(c), r"(?s)^---\s*\n(.*?)\n---\s*\n", 1)
    field = lambda key: F.nullif(F.trim(F.regexp_extract(block, rf"(?m)^{key}:[ \t]*(.*)$", 1)), F.lit(""))
    return field("name"), field("description")


def lines_within(c: Column, budget: int) -> Column:
    """The first lines of a text while their estimated tokens stay within ``budget``; texts within it stay whole."""
    lines = F.split(filled(c), "\n")
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("kept"))

    def step(s: Column, line: Column) -> Column:
        used = s["used"] + F.floor(F.length(line) / 4)
        return F.struct(used.alias("used"), F.when(used <= budget, s["kept"] + 1).otherwise(s["kept"]).alias("kept"))

    kept = F.aggregate(lines, start, step, lambda s: s["kept"])
    return F.when(token_estimate(c) <= budget, filled(c)).otherwise(F.array_join(F.slice(lines, F.lit(1), kept), "\n"))


def coerced(value: Column, kind: Column) -> Column:
    """Struct (number, integer, flag, text) of an argument by its declared type, one field set.

    Names of types may be in either case. An argument that does not read as its type, or whose
    type is not known, stays text; every text is a flag, true for true, 1 and yes in either case.
    """
    k = F.lower(filled(kind))
    number = F.when(k.isin("number", "float"), value.try_cast("double"))
    integer = F.when(k.isin("integer", "int"), F.when(value.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(value).try_cast("long")))
    flag = F.when(k.isin("boolean", "bool"), F.lower(value).isin("true", "1", "yes"))
    text = F.when(number.isNull() & integer.isNull() & flag.isNull(), value)
    return F.struct(number.alias("number"), integer.alias("integer"), flag.alias("flag"), text.alias("text"))


def setting_flag(value: Column) -> Column:
    """Whether a setting's text means yes; null where it is not set."""
    return F.when(filled(value) != "", F.lower(F.trim(value)).isin("1", "true", "yes", "on"))


def selected_answer(response: Column, n: int) -> Column:
    """Struct (query, place) of a reply that names a question and the number of its document, of n; both null where it does not."""
    lines = F.filter(F.transform(F.split(filled(response), r"\r\n|\r|\n"), stripped), lambda x: x != "")
    after = lambda words: F.regexp_extract(F.get(F.filter(lines, lambda x: F.contains(x, F.lit(words))), F.lit(0)), rf"{words}(.*)$", 1)
    query = stripped(after("问题："))
    number = F.regexp_extract(after("编号"), r"^[：:.)） ]*([+-]?[0-9]+)[：:.)） ]*$", 1).try_cast("int") - 1
    good = (query != "") & number.between(0, n - 1)
    return F.struct(F.when(good, query).alias("query"), F.when(good, number).alias("place"))


def search_body(keywords: Column, fields: dict[str, tuple[float, bool]], synonyms: dict[str, list[str]] | None = None) -> Column:
    """The body of a keyword search as JSON: for each word and field (boost, fuzzy), the exact term, close terms and a phrase.

    Exact terms count 1.2 times the boost, close ones 0.5, phrases of words of two characters or
    more 0.8; 30 % of the clauses must match. Without a word nothing matches.
    """
    def quoted(c: Column) -> Column:
        body = F.to_json(F.array(c))
        return F.substr(body, F.lit(2), F.length(body) - 2)

    known = F.create_map(*(x for w, s in (synonyms or {}).items() for x in (F.lit(w), F.array(*map(F.lit, s))))) if synonyms else None

    def clause(word: Column, field: str, boost: float, fuzzy: bool) -> Column:
        same = F.coalesce(F.try_element_at(known, word), F.array(word)) if synonyms else F.array(word)
        none = F.array().cast("array<string>")
        parts = [F.array(F.concat(F.lit(f'{{"terms":{{"{field}.keyword":'), F.to_json(same), F.lit(f',"boost":{boost * 1.2}}}}}')))]
        if fuzzy:
            parts.append(F.transform(same, lambda s: F.concat(F.lit(f'{{"match":{{"{field}":{{"query":'), quoted(s), F.lit(f',"fuzziness":"AUTO","boost":{boost * 0.5}}}}}}}'))))
        phrase = F.transform(same, lambda s: F.concat(F.lit(f'{{"match_phrase":{{"{field}":{{"query":'), quoted(s), F.lit(f',"slop":2,"boost":{boost * 0.8}}}}}}}')))
        parts.append(F.when(F.length(word) > 1, phrase).otherwise(none))
        return F.concat(F.lit('{"bool":{"should":['), F.array_join(F.concat(*parts), ","), F.lit('],"minimum_should_match":1}}'))

    each = F.flatten(F.transform(keywords, lambda w: F.array(*(clause(w, f, *how) for f, how in fields.items()))))
    query = F.when(F.size(each) > 0, F.concat(F.lit('{"bool":{"should":['), F.array_join(each, ","), F.lit('],"minimum_should_match":"30%"}}'))).otherwise('{"match_none":{}}')
    return F.concat(F.lit('{"query":'), query, F.lit(',"highlight":{"fields":{"*":{"pre_tags":["<em>"],"post_tags":["</em>"]}}}}'))


def corpus_text(title: Column, summary: Column, question: Column, text: Column) -> Column:
    """What a keyword index reads of a block: four fields with a space between, missing ones empty."""
    return F.concat_ws(" ", *map(filled, (title, summary, question, text)))


def from_template(template: str, values: dict[str, Column]) -> Column:
    """A prompt: the ``{name}`` places of a template filled with columns in one pass, so that braces in values stay; nulls are empty."""
    parts = []
    for literal, name, _, _ in Formatter().parse(template):
        parts.append(F.lit(literal))
        if name is not None:
            parts.append(filled(values[name]))
    return F.concat(*parts) if parts else F.lit("")


def numbered(texts: Column, label: str, most: int | None = None) -> Column:
    """An array of texts as lines "label1: text", each cut to ``most`` characters; nulls are empty."""
    cut = lambda x: filled(x) if most is None else F.left(filled(x), F.lit(most))
    return F.array_join(F.transform(texts, lambda x, i: F.concat(F.lit(label), (i + 1).cast("string"), F.lit(": "), cut(x))), "\n")
