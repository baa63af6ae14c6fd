"""Text functions as Column -> Column; lengths count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as web text has it.
SPACE = r"[ \t\n\x0B\f\r\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"

#: What becomes one blank when white space is collapsed: every run of it but a lone blank, which is one already. Most characters are told by the range before &&.
UNEVEN = f"[[^!-~]&&{SPACE[:-1]}]{{2,}}|[[^!-~]&&[{SPACE[2:-1]}]"
#: A character that isn't white space.
SOLID = f"[^{SPACE[1:-1]}"

# Words that carry no meaning in a question.
STOP_WORDS = (
    "an and about are as at be by can did do does explain for from has have how in into is it of on or should that the this to use was were what when where which why will with"
).split() + ["为什么", "什么", "哪些", "如何", "怎么", "这个", "这篇"]

# Questions about a whole article, as scope and task words.
WHOLE_SCOPE_ZH = "全文|全篇|整篇|全部|所有|整体|文章内容|网页内容|页面内容|文档内容|整个(?:文章|网页|页面|文档)|(?:这|本)篇(?:文章|网页|文档)"
WHOLE_TASK_ZH = "总结|概括|梳理|归纳|提炼|整理|组织|分析|介绍|摘要|大纲|(?:核心|主要)?(?:观点|要点|主旨)|主要内容|讲了什么|说了什么"
WHOLE_SCOPE_EN = r"\b(?:all|everything|whole|entire|full|overall|article|page|document|content)\b"
WHOLE_TASK_EN = r"\b(?:summari[sz]e|summary|outline|overview|recap|main (?:idea|point|argument)s?)\b"
WHOLE_ABOUT_EN = r"\bwhat (?:is|does) (?:this|the) (?:article|page|document) (?:about|cover|discuss)\b"


def clean(text: Column) -> Column:
    """White space collapsed and trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), UNEVEN, " "))


def normalize_literal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), UNEVEN, " "))


def _pairs(runs: Column) -> Column:
    """All neighbouring pairs of characters of every run."""
    return F.flatten(F.transform(runs, lambda r: F.when(F.length(r) > 1, F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda k: F.substr(r, k, F.lit(2)))).otherwise(F.array())))


def token_set(text: Column) -> Column:
    """Distinct runs of letters, digits, _ and - of two characters at least, and the pairs in runs of Chinese characters."""
    low = F.lower(F.coalesce(text, F.lit("")))
    words = F.regexp_extract_all(low, F.lit(r"([\p{L}\p{N}_-]{2,})"), 1)
    return F.array_distinct(F.concat(words, _pairs(F.regexp_extract_all(low, F.lit(r"([\x{3400}-\x{9FFF}]+)"), 1))))


def retrieval_terms(text: Column) -> Column:
    """Terms in order, with repeats: ASCII words of two characters at least and pairs (or lone ones) of Chinese characters, without stop words."""
    low = F.lower(F.coalesce(text, F.lit("")))
    words = F.regexp_extract_all(low, F.lit("[a-z0-9_]{2,}"), 0)
    runs = F.regexp_extract_all(low, F.lit(r"([\x{3400}-\x{9FFF}]+)"), 1)
    pairs = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) == 1, F.array(r)).otherwise(_pairs(F.array(r)))))
    return F.filter(F.concat(words, pairs), lambda w: ~w.isin(*STOP_WORDS))


def overlap_score(query: Column, content: Column) -> Column:
    """Share of the query's tokens that the content's have; 0 without any."""
    return F.when(F.size(query) == 0, 0.0).otherwise(F.size(F.array_intersect(query, content)) / F.size(query))


def is_whole_article_question(question: Column) -> Column:
    q = F.lower(F.trim(F.coalesce(question, F.lit(""))))
    return (q.rlike(WHOLE_SCOPE_ZH) & q.rlike(WHOLE_TASK_ZH)) | (q.rlike(WHOLE_SCOPE_EN) & q.rlike(WHOLE_TASK_EN)) | q.rlike(WHOLE_ABOUT_EN)


#: What quotes a literal in a question, as patterns with one group.
QUOTED = ("`([^`]+)`", '"([^"]+)"', "“([^”]+)”", "‘([^’]+)’", "「([^」]+)」", "『([^』]+)』")


def exact_literals(question: Column, focus: Column | None = None) -> Column:
    """Distinct literals, the longest first: the focus, what is quoted, and identifier-like runs that aren't stop words."""
    quoted = F.concat(*[F.regexp_extract_all(F.coalesce(question, F.lit("")), F.lit(p), 1) for p in QUOTED])
    given = F.concat(F.array(F.coalesce(focus, F.lit("")) if focus is not None else F.lit("")), quoted)
    long = F.filter(F.transform(given, normalize_literal), lambda w: F.length(w) >= 3)
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    runs = F.filter(F.transform(F.regexp_extract_all(F.coalesce(question, F.lit("")), F.lit(r"([\p{L}\p{N}_./:-]{3,})"), 1), normalize_literal), lambda w: ~F.array_contains(stop, w))
    every = F.array_distinct(F.concat(long, runs))
    # One expression over the array, which would be made anew wherever it is named.
    ranked = F.array_sort(F.transform(every, lambda w, k: F.struct((-F.length(w)).alias("n"), k.alias("k"), w.alias("w"))))
    return F.transform(ranked, lambda s: s["w"])


def chunk_cost(section: Column, text: Column) -> Column:
    """What a chunk takes of a character budget."""
    return F.length(section) + F.length(text) + 3


def even_indexes(length: Column, count: Column) -> Column:
    """Distinct indexes spread evenly from first to last; halves round up."""
    steps = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(2)) - 1), lambda i: F.floor(i * (length - 1) / (F.greatest(count, F.lit(2)) - 1) + 0.5).cast("int"))
    return F.when(count <= 1, F.array(F.lit(0))).otherwise(F.array_distinct(steps))
