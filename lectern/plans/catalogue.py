"""All registered queries of the reading-context engine over the stored tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import reading as R
from lectern.functions import text as T
from lectern.functions import urls
from lectern.functions.markdown import normalized_markdown
from lectern.functions.model_json import checkpoint, query_plan
from lectern.operators import assemble, chunking, context, extract, index, memory, prompts, retrieve, search, store, turns
from lectern.plans.fold_sql import FOLDS
from lectern.plans.sql import SQL
from lectern.settings import Settings
from lectern.sources import tables as S
from lectern.sources.scratch import new_path, stored
from lectern.streaming import operations

Q = {}


def query(f):
    Q[f.__name__] = f
    return f


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "documents")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return S.questions(S.table(spark, d, "benchmark"))


def _messages(spark: SparkSession, d: str) -> DataFrame:
    return S.messages(S.table(spark, d, "conversations"))


def _as_queries(asked: DataFrame) -> DataFrame:
    return asked.select("query_id", F.lit(0).alias("pos"), F.col("question").alias("text"))


@query
def url_normalize(spark, d):
    return S.table(spark, d, "pages").select("page_id", urls.normalize_page_url(F.col("url")).alias("normalized_url"), urls.page_key(F.col("page_id"), F.col("url")).alias("page_key"), urls.is_supported(F.col("url")).alias("supported"))


@query
def url_hosts(spark, d):
    return S.table(spark, d, "pages").groupBy(urls.hostname(F.col("url")).alias("host")).agg(F.count("*").alias("pages"))


@query
def token_sets(spark, d):
    tokens = T.token_set(F.col("text"))
    return _docs(spark, d).select("doc_id", F.size(tokens).cast("long").alias("n_tokens"), F.md5(F.array_join(F.array_sort(tokens), " ").cast("binary")).alias("tokens_md5"))


@query
def term_stats(spark, d):
    """Of every term, in how many documents of a language it occurs, and how often."""
    terms = _docs(spark, d).select("lang", F.array_sort(T.retrieval_terms(F.col("text"))).alias("t"))  # sorted, so a document's repeats are behind its first
    marked = F.transform("t", lambda x, k: F.struct(x.alias("term"), F.when((k == 0) | (F.get("t", k - 1) != x), 1).otherwise(0).alias("first")))
    return terms.select("lang", F.explode(marked).alias("m")).groupBy("lang", "m.term").agg(F.sum("m.first").alias("docs"), F.count("*").alias("occurrences"))


@query
def overlap_topk(spark, d):
    """The five documents that share most tokens with each question, by an inverted index on the questions' tokens."""
    return search.overlaps(_docs(spark, d), _asked(spark, d), 5)


@query
def bm25_topk(spark, d):
    ranked = search.bm25(S.document_chunks(_docs(spark, d)), _as_queries(_asked(spark, d)), most=5)
    return ranked.select("article_id", "query_id", F.col("chunk_idx").alias("doc_id"), F.col("matched").cast("long"), F.round("score", 5).alias("score"), "rank")


@query
def indexed_topk(spark, d):
    """bm25_topk from a stored index: drafts of every seventh document are indexed with the others, then a delta takes them out and puts the documents in."""
    chunks, path = S.document_chunks(_docs(spark, d)), new_path(spark, "index")
    drafted = F.pmod("chunk_idx", F.lit(7)) == 3
    drafts = chunks.filter(drafted).withColumn("text", F.concat(F.lit("draft "), F.reverse("text")))
    index.add(path, "first", chunks.filter(~drafted).unionByName(drafts), block=16)
    index.add(path, "delta", chunks.filter(drafted), drafts, block=16)
    ranked = index.Search(spark, path, _as_queries(_asked(spark, d)), 5, block=16).best()
    return ranked.select("article_id", "query_id", F.col("chunk_idx").alias("doc_id"), F.col("matched").cast("long"), F.round("score", 5).alias("score"), "rank")


@query
def rrf_fusion(spark, d):
    """Two queries a question, its two halves, fused by reciprocal ranks."""
    words = F.split("question", " ")
    half = F.floor((F.size(words) + 1) / 2).cast("int")
    halves = _asked(spark, d).select("query_id", F.posexplode(F.array(F.array_join(F.slice(words, 1, half), " "), F.array_join(F.slice(words, half + 1, F.size(words)), " "))).alias("pos", "text"))
    fused = search.fuse(search.bm25(S.document_chunks(_docs(spark, d)), search.distinct_queries(halves)))
    return fused.filter("place <= 5").select("article_id", "query_id", F.col("chunk_idx").alias("doc_id"), F.round("fused", 9).alias("fused"), "best_rank", "place")


@query
def neighbor_window(spark, d):
    return search.neighbours(S.sectioned_lines(_docs(spark, d)))


@query
def exact_match_rank(spark, d):
    """Documents that hold the questions' words in a row, and single literals; the best three by longest match."""
    asked = _asked(spark, d).select("query_id", F.concat(F.lit('"'), "question", F.lit('"')).alias("question"))
    return search.literal_matches(S.document_chunks(_docs(spark, d)), asked).filter("place <= 3").select("article_id", "query_id", F.col("chunk_idx").alias("doc_id"), F.col("longest").cast("long"), "matches", "place")


@query
def focus_anchor(spark, d):
    """The line of each document nearest to the question it is asked, in its second part or else anywhere, and neighbours."""
    foci = S.asked_of(_docs(spark, d), S.table(spark, d, "benchmark")).join(_docs(spark, d).select(F.col("doc_id").alias("article_id"), F.concat_ws(" > ", "lang", "source", F.lit("part 1")).alias("focus_section")), "article_id")
    return search.focus_anchors(S.sectioned_lines(_docs(spark, d)), foci.withColumnRenamed("question", "focus_text")).select("article_id", "query_id", "chunk_idx", "place")


@query
def section_scope(spark, d):
    """The second part of a document in lines, all of its source in other letters, or the whole of it, by turns."""
    section = F.concat_ws(" > ", "lang", "source")
    turn = F.pmod("doc_id", F.lit(3))
    foci = _docs(spark, d).select(F.col("doc_id").alias("article_id"), F.lit(0).alias("query_id"), F.when(turn == 0, F.concat(section, F.lit(" > part 1"))).when(turn == 1, F.upper(section)).otherwise("elsewhere").alias("focus_section"), F.when(turn == 2, 1).otherwise(2).alias("heading_level"))
    return search.section_scope(S.sectioned_lines(_docs(spark, d)), foci, budget=2000).select("article_id", "chunk_idx")


@query
def select_context(spark, d):
    """Every document is asked one question in one of four ways: of the whole, of a section, of words in focus, or by search."""
    turn = F.pmod("article_id", F.lit(4))
    section = F.concat_ws(" > ", "lang", "source", F.lit("part 1"))
    asked = S.asked_of(_docs(spark, d), S.table(spark, d, "benchmark")).join(_docs(spark, d).select(F.col("doc_id").alias("article_id"), section.alias("_section")), "article_id")
    questions = asked.select(
        "article_id", "query_id", F.when(turn == 0, "Summarize the whole article").otherwise(F.col("question")).alias("question"), F.lit(None).cast("array<string>").alias("search_queries"), F.when(turn == 2, F.col("question")).alias("focus_text"),
        F.when(turn == 1, F.col("_section")).alias("focus_section"), F.when(turn == 1, "section").alias("focus_scope"), F.when(turn == 1, 3).alias("heading_level"),
    )
    return retrieve.article_context(stored(S.sectioned_lines(_docs(spark, d)), "lines"), questions, 1, 10**7, 10**7).select("article_id", "query_id", "mode", "truncated", "branch", "rank", "chunk_id", F.col("cost").cast("long").alias("cost"))


@query
def question_context(spark, d):
    """The whole context of a question to each document, within 3,000 characters, in eight ways by turns: nothing more is known, a section or words are in focus,
    or nothing that can be found, the question is planned (also with the conversation), the document's parts are wanted, and there is a checkpoint."""
    turn, section = F.pmod("article_id", F.lit(8)), F.concat_ws(" > ", "lang", "source")
    wide = F.pmod("article_id", F.lit(16)) == 14
    docs = _docs(spark, d)
    # Documents whose parts are wanted have sections of one line
    path = lambda ord_: F.when(turn == 6, F.concat(F.lit("part "), ord_.cast("string"), F.lit(" > "), F.col("section"))).otherwise(F.concat(F.col("section"), F.lit(" > part "), F.floor(ord_ / 5).cast("string")))
    chunks = stored(S.document_blocks(docs).select("article_id", F.col("ord").alias("chunk_idx"), F.concat(F.lit("chunk-"), F.col("ord") + 1).alias("chunk_id"), path(F.col("ord")).alias("section"), "text", F.array("block_id").alias("block_ids")), "context-chunks")
    words = F.split("question", " ")
    some = lambda a, n: F.array_join(F.slice(words, a, n), " ")
    need = lambda a, why: F.struct(some(a, 5).alias("query"), F.lit(why).alias("reason"))
    plan = F.to_json(F.struct(some(1, 12).alias("rewrittenQuestion"), F.array(some(13, 12)).alias("queries"), F.array(need(1, "first"), need(6, "second")).alias("evidenceNeeds"), F.when(wide, "document-wide").otherwise("focused").alias("coverage"), (turn == 5).alias("useConversation")))
    asked = S.asked_of(docs, S.table(spark, d, "benchmark")).join(docs.select(F.col("doc_id").alias("article_id"), section.alias("_base")), "article_id")
    questions = asked.select(
        "article_id", "query_id", F.col("article_id").alias("conv_id"), F.when((turn == 6) & ~wide, F.concat(F.lit("Summarize the whole article: "), "question")).otherwise(F.col("question")).alias("question"), F.when(turn.isin(1, 2, 3), "text").alias("focus_type"),
        F.when(turn == 2, F.col("question")).alias("focus_text"), F.when(turn == 1, F.concat("_base", F.lit(" > part 1"))).alias("focus_section"), F.when(turn == 1, "section").alias("focus_scope"), F.when(turn == 1, 3).alias("heading_level"),
        F.when(turn.isin(4, 5) | wide, plan).alias("plan_json"), F.when(turn == 7, F.repeat(F.lit("x"), 700)).alias("checkpoint_json"), turn.isin(4, 5).alias("planned"),
    )
    made = context.question_context(chunks, questions, memory.completed_turns(_messages(spark, d)), Settings(request_budget=3000))
    line = lambda e: F.concat_ws("|", e["chunk_id"], F.array_join(F.array_sort(e["sources"]), "+"), e["pinned"].cast("string"), F.round(e["score"] * 10**9).cast("long").cast("string"), e["cost"].cast("string"))
    told = lambda t: F.concat_ws(":", t["turn_idx"].cast("string"), t["how"])
    return made.select(
        "article_id", "query_id", "strategy", "mode", "is_truncated", "needs_planning", "full_article_characters", "article_characters", "history_characters", "checkpoint_characters",
        F.coalesce(F.array_join(F.transform("history", told), ","), F.lit("")).alias("history"), F.coalesce(F.array_join(F.transform("evidence", line), ";"), F.lit("")).alias("evidence"),
    )


@query
def request_budgets(spark, d):
    """What a request about each document has for article and history, by turns with a checkpoint, a plan that uses the conversation, and planning done."""
    id_ = F.col("article_id")
    asked = _docs(spark, d).select(F.col("doc_id").alias("article_id"), F.lit(0).cast("long").alias("query_id")).select("*", (id_ % 1000 * 20).alias("history_length"), (id_ % 2 == 0).alias("use_conversation"), (id_ % 3 == 0).alias("planned"), F.when(id_ % 5 == 0, F.repeat(F.lit("x"), 700)).alias("checkpoint_json"))
    return retrieve.budgets(S.sectioned_lines(_docs(spark, d)), asked, 3000)


@query
def coverage_groups(spark, d):
    """Groups of a source's documents: by the first part of their path, or by the first two where all share the first (sources of even length)."""
    path = F.when(F.length("source") % 2 == 0, F.concat_ws(" > ", "source", "lang", F.lit("leaf"))).otherwise(F.concat_ws(" > ", "lang", "source"))
    return search.coverage_groups(_docs(spark, d).select(F.col("source").alias("article_id"), F.col("doc_id").alias("chunk_idx"), path.alias("section")))


@query
def even_spacing(spark, d):
    """Which lines of a document five evenly spaced ones are."""
    sizes = S.document_blocks(_docs(spark, d)).groupBy("article_id").agg(F.count("*").cast("int").alias("n"))
    return sizes.select("article_id", F.explode(T.even_indexes(F.col("n"), F.least(F.col("n"), F.lit(5)))).alias("idx"))


@query
def whole_question(spark, d):
    """The user's messages as they are, and behind questions about a whole article in two languages."""
    before = F.when(F.col("msg_idx") % 4 == 0, "Summarize the whole page: ").when(F.col("msg_idx") % 4 == 1, "What is the article about? ").when(F.col("msg_idx") % 4 == 2, "请总结全文：").otherwise("")
    made = _messages(spark, d).filter("role = 'user'").withColumn("question", F.concat(before, F.col("content")))
    return made.select("conv_id", "msg_idx", T.is_whole_article_question(F.col("question")).alias("whole"))


@query
def completed_turns(spark, d):
    return memory.completed_turns(_messages(spark, d)).select("conv_id", F.col("turn_idx").cast("long"), "question", "answer", F.col("turn_length").cast("long"))


@query
def recent_turns_budget(spark, d):
    return memory.recent_turns(memory.completed_turns(_messages(spark, d)), 1500, 2).select("conv_id", F.col("turn_idx").cast("long"), F.col("newest").cast("long"), F.col("used").cast("long"))


def _last_questions(spark, d):
    return _messages(spark, d).filter("role = 'user'").groupBy("conv_id").agg(F.max_by("content", "msg_idx").alias("question"))


@query
def recalled_turns(spark, d):
    found = memory.recalled_turns(memory.completed_turns(_messages(spark, d)), _last_questions(spark, d), 1, 2)
    return found.select("conv_id", F.col("turn_idx").cast("long"), F.round("score", 6).alias("score"), F.col("place").cast("long"))


@query
def memory_selection(spark, d):
    return memory.select_memory(memory.completed_turns(_messages(spark, d)), _last_questions(spark, d), 1800, 900, 1, 2).select("conv_id", F.col("turn_idx").cast("long"), "how", "compacted")


@query
def trace_retention(spark, d):
    return memory.kept_traces(_messages(spark, d), 2)


@query
def question_rail(spark, d):
    return memory.question_rail(_messages(spark, d))


def _archive(spark, d):
    """Conversations as archived pages: one URL and title each."""
    return _messages(spark, d).withColumn("url", F.concat(F.lit("https://example.com/c/"), F.col("conv_id").cast("string"))).withColumn("title", F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")))


@query
def archive_summary(spark, d):
    return memory.summaries(_archive(spark, d)).select("url", "title", "created_at", "updated_at", F.col("question_count").cast("long"), "last_question")


@query
def archive_search(spark, d):
    return memory.search_archive(_archive(spark, d), " The ").select("url", F.col("question_count").cast("long"))


@query
def archive_usage(spark, d):
    return memory.usage(_archive(spark, d))


@query
def archive_bytes(spark, d):
    """The bytes of all archived records, two conversations a page, against the quota."""
    held = store.save_conversations(spark.createDataFrame([], store.CONVERSATION), S.page_contexts(S.table(spark, d, "conversations")), F.lit(1000))
    return store.usage(held, Settings().archive_quota)


@query
def archive_merge(spark, d):
    """Two conversations a page; the even ones are archived, the odd ones come in and overwrite the first question."""
    turns = memory.completed_turns(_messages(spark, d))
    page = F.concat(F.lit("https://example.com/p/"), F.floor(F.col("conv_id") / 2).cast("string")).alias("url")
    rows = turns.select("conv_id", page, F.when(F.col("turn_idx") == 0, "first").otherwise(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn_idx").cast("string"))).alias("question_id"), F.col("turn_idx").cast("long").alias("pos"), F.col("turn_idx").cast("long").alias("created_at"), "question", "answer")
    # A conversation may have its first completed turn later than its first message; only place 0 is named "first".
    merged = memory.merge_turns(rows.filter("conv_id % 2 = 0").drop("conv_id"), rows.filter("conv_id % 2 = 1").drop("conv_id"))
    return merged.select("url", "question_id", F.col("ord").cast("long"), "created_at", "question")


@query
def conversation_archive(spark, d):
    """Contexts of every second conversation are archived, then the others come in: titles, times and turns of every page."""
    contexts = S.page_contexts(S.table(spark, d, "conversations"))
    empty = spark.createDataFrame([], store.CONVERSATION)
    first = store.save_conversations(empty, contexts.filter("tab_id % 2 = 0"), F.lit(1000))
    both = store.save_conversations(first, contexts.filter("tab_id % 2 = 1"), F.lit(2000))
    return both.select("normalized_url", "title", "created_at", "updated_at", F.size("messages").cast("long").alias("n_messages"), F.array_join(F.transform("messages", lambda m: m["id"]), ",").alias("message_ids"))


@query
def archive_list(spark, d):
    """The summaries of archived conversations that hold a word."""
    contexts = S.page_contexts(S.table(spark, d, "conversations"), 1)
    held = store.save_conversations(spark.createDataFrame([], store.CONVERSATION), contexts, F.lit(5))
    return store.summaries(held, "the").select("normalized_url", "title", "created_at", "updated_at", "question_count", "last_question")


@query
def context_clear(spark, d):
    """All messages are cleared, in contexts that have any."""
    contexts = S.page_contexts(S.table(spark, d, "conversations"))
    some = contexts.withColumn("messages", F.when(F.col("tab_id") % 3 == 0, F.slice("messages", 1, 0)).otherwise(F.col("messages")))
    return store.clear_messages(some, F.lit(9999)).select("tab_id", F.size("messages").cast("long").alias("n_messages"), "updated_at")


@query
def turn_recovery(spark, d):
    """Every second context was left answering: its last question is in error."""
    contexts = S.page_contexts(S.table(spark, d, "conversations")).withColumn("status", F.when(F.col("tab_id") % 2 == 0, "answering").otherwise("ready"))
    wrong = F.filter("messages", lambda m: F.coalesce(m["error"], F.lit(False)))
    return turns.recover_turn(contexts, F.lit(9999)).select("tab_id", "status", "updated_at", F.array_join(F.transform(wrong, lambda m: m["id"]), ",").alias("failed"))


@query
def checkpoint_prepare(spark, d):
    """How much of a conversation's turns a checkpoint that covers some of them stands for, and what is left to take in."""
    done = memory.completed_turns(_messages(spark, d)).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn_idx"))), lambda t: t["turn_idx"].cast("string")).alias("answers"))
    covered = (F.col("conv_id") % 4).cast("int")
    through = F.coalesce(F.get("answers", covered - 1), F.lit("none"))
    made = done.select("conv_id", R.to_compact(covered, F.when(F.col("conv_id") % 8 < 4, through).otherwise("other"), F.col("answers")).alias("p"))
    return made.select("conv_id", F.col("p.keeps_previous").alias("keeps_previous"), F.array_join("p.answers", ",").alias("answers"), F.col("p.covered").cast("long").alias("covered"), F.col("p.needs_update").alias("needs_update"))


@query
def history_lines(spark, d):
    """The last four messages of each conversation's completed turns, each cut to 60 characters."""
    done = memory.completed_turns(_messages(spark, d)).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn_idx", "question", "answer"))).alias("turns"))
    return done.select("conv_id", prompts.recent_history(F.col("turns"), 4, 60).alias("history"))


@query
def translation_retry(spark, d):
    """Whether an answer that repeats the question's words is asked again."""
    return _messages(spark, d).select("conv_id", "msg_idx", R.unchanged_translation(F.lower("content"), F.when(F.col("msg_idx") % 2 == 0, F.upper("content")).otherwise(F.concat("content", F.lit("x")))).alias("again"))


@query
def outline(spark, d):
    """Sources of a language's documents in order of appearance, as an outline of up to 100 characters."""
    first = _docs(spark, d).groupBy("lang", F.col("source").alias("section")).agg(F.min("doc_id").alias("_first"))
    held = first.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("_first", "section"))).alias("s"))
    return held.select("lang", R.outline(F.transform("s", lambda x: x["section"]), F.col("lang"), 100).alias("outline"))


@query
def full_context_fit(spark, d):
    """Which sources' documents fit a request whole, as the assembler decides: its evidence, added up."""
    chunks = S.document_chunks(_docs(spark, d)).select("*", F.concat(F.lit("chunk-"), F.col("chunk_idx").cast("string")).alias("chunk_id"), F.array(F.col("chunk_idx").cast("string")).alias("block_ids"))
    asked = chunks.select("article_id").distinct().select("*", F.lit(0).cast("long").alias("query_id"), F.lit(500).alias("history_length"), F.lit(None).cast("string").alias("plan_json"), F.lit(None).cast("string").alias("checkpoint_json"))
    none = chunks.select("article_id", F.lit(0).cast("long").alias("query_id"), F.lit("exact-match").alias("source"), F.lit(None).cast("int").alias("need"), F.lit(1).alias("place"), "chunk_idx").limit(0)
    made = assemble.assemble(chunks, asked, none, 110_000)
    return made.groupBy("article_id", "strategy").agg(F.count("*").alias("chunks"), F.sum("cost").cast("long").alias("article_characters"))


@query
def query_plan_parse(spark, d):
    """Plans in JSON, made of benchmark texts in five shapes, read back."""
    q, quoted = F.col("question"), F.to_json(F.struct(F.col("question").alias("q")))
    text = F.regexp_extract(quoted, r'(?s)^\{"q":(.*)\}$', 1)  # the question as a JSON string
    shape = F.pmod("query_id", F.lit(5))
    made = (
        F.when(shape == 0, F.concat(F.lit('```json {"rewrittenQuestion": '), text, F.lit(', "queries": ['), text, F.lit(", "), F.lower(text), F.lit(', "b", "", 7, "c", "d", "e"], "coverage": "multi-section", "useConversation": true} ```')))
        .when(shape == 1, F.concat(F.lit('{"rewrittenQuestion": '), text, F.lit(', "evidenceNeeds": [{"query": "need", "reason": " r "}, {"reason": "x"}, {"query": '), text, F.lit('}], "coverage": "odd", "useConversation": "true"}')))
        .when(shape == 2, F.concat(F.lit('{"queries": ['), text, F.lit("]}")))
        .when(shape == 3, q)
        .otherwise(F.concat(F.lit('{"rewrittenQuestion": "  '), F.repeat(F.lit("ab "), 300), F.lit('"}')))
    )
    plan = _asked(spark, d).select("query_id", query_plan(made).alias("p"))
    needs = F.transform("p.evidence_needs", lambda n: F.concat(n["query"], F.lit("/"), n["reason"]))
    return plan.select("query_id", F.col("p.rewritten_question").alias("rewritten"), F.array_join("p.queries", "|").alias("queries"), F.array_join(needs, "|").alias("needs"), F.col("p.coverage").alias("coverage"), F.col("p.use_conversation").alias("use_conversation"))


@query
def checkpoint_validate(spark, d):
    """Checkpoints with the benchmark texts as goals, whole or repeated past the limit."""
    made = S.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.regexp_replace("text", r'[\n"\\\\]', " ").alias("_t"))
    goal = F.when(F.col("query_id") % 2 == 0, F.col("_t")).otherwise(F.repeat("_t", 9))
    read = made.select("query_id", checkpoint(F.concat(F.lit('{"goal": "'), goal, F.lit('", "activeTopic": "t", "items": [{"text": "x", "status": "active"}], "decisions": [], "userConstraints": ["u"], "unresolvedReferences": []}'))).alias("c"))
    return read.select("query_id", F.col("c.goal").isNotNull().alias("valid"), F.coalesce(F.length("c.goal"), F.lit(0)).cast("long").alias("goal_length"))


@query
def chunks(spark, d):
    return chunking.chunks(S.document_blocks(_docs(spark, d))).select("article_id", "chunk_idx", "section", "text", F.array_join("block_ids", ",").alias("block_ids"))


@query
def chunk_bounds(spark, d):
    """Characters and lines that each document's chunks hold together."""
    made = chunking.chunks(S.document_blocks(_docs(spark, d)))
    lines = F.array_distinct(F.transform(F.flatten(F.collect_list("block_ids")), lambda b: F.regexp_replace(b, "-part-[0-9]+$", "")))
    return made.groupBy("article_id").agg(F.sum(F.length(F.replace("text", F.lit("\n"), F.lit("")))).cast("long").alias("characters"), F.size(lines).cast("long").alias("lines"))


@query
def document_coverage(spark, d):
    return assemble.covered(S.sectioned_lines(_docs(spark, d)), 2000, 4)


@query
def window_pack(spark, d):
    """Windows around the lines that match the question a document is asked best, within 2,000 characters."""
    lines = stored(S.sectioned_lines(_docs(spark, d)), "lines")
    asked = S.asked_of(_docs(spark, d), S.table(spark, d, "benchmark")).select("article_id", "query_id", F.lit(0).alias("pos"), F.col("question").alias("text"))
    return assemble.packed_windows(lines, search.fuse(search.bm25(lines, asked)), 2000, 4)


@query
def evidence_pack(spark, d):
    """Fused evidence for the question each document is asked, within 3,000 characters with 500 of history."""
    lines = stored(S.sectioned_lines(_docs(spark, d)), "lines")
    asked = S.asked_of(_docs(spark, d), S.table(spark, d, "benchmark"))  # not stored: a file of repeated questions looks small enough to be sent to every task
    own = asked.select("article_id", "query_id")
    exact = search.literal_matches(lines, asked).filter("place <= 8")
    ranked = search.fuse(search.bm25(lines, asked.select("article_id", "query_id", F.lit(0).alias("pos"), F.col("question").alias("text"))))
    spread = assemble.covered(lines, 1000, 3).join(own, "article_id").withColumn("place", F.col("chunk_idx"))
    offer = lambda df, source: df.select("article_id", "query_id", F.lit(source).alias("source"), F.lit(None).cast("int").alias("need"), F.col("place").cast("int"), "chunk_idx")
    channels = stored(offer(exact, "exact-match").unionByName(offer(ranked, "global-search")).unionByName(offer(spread, "document-coverage")), "channels")
    questions = own.select("*", F.lit(500).alias("history_length"), F.lit(None).cast("string").alias("plan_json"), F.lit(None).cast("string").alias("checkpoint_json"))
    return assemble.assemble(lines, questions, channels, 3000)


@query
def page_extract(spark, d):
    read = extract.articles(S.table(spark, d, "pages"), "title", "blocks", "is_partial")
    return read.select("article_id", "title", F.size("blocks").cast("long").alias("n_blocks"), F.array_join(F.transform("blocks", lambda b: b["text"]), "\n").alias("text"), "is_partial")


@query
def page_blocks(spark, d):
    return extract.blocks(extract.articles(S.table(spark, d, "pages"), "blocks")).select("article_id", "ord", "type", "text", "section", "level")


@query
def reading_scope(spark, d):
    return extract.reading_scope(S.document_blocks(_docs(spark, d)))


@query
def page_diagnostics(spark, d):
    read = extract.articles(S.table(spark, d, "pages"), "diagnostics")
    return read.select("article_id", F.array_join(extract.diagnostic_issues(F.col("diagnostics")), ",").alias("issues"), F.col("diagnostics.root_kind").alias("root_kind"), F.col("diagnostics.readable_length").cast("long").alias("readable_length"))


@query
def diagnostics_totals(spark, d):
    return extract.diagnostics_totals(extract.articles(S.table(spark, d, "pages"), "is_partial", "diagnostics"))


@query
def diagnostic_rules(spark, d):
    """What counters made of document numbers say is wrong."""
    n = F.col("doc_id").cast("int")
    names = ("article_candidate_count", "iframe_count", "canvas_count", "shadow_root_count", "loading_indicator_count", "excluded_block_count")
    made = F.struct(F.when(n % 3 == 0, "body").otherwise("article").alias("root_kind"), (n % 200).alias("readable_length"), F.lit(80).alias("minimum_readable_length"), (n % 700).alias("root_text_length"), (n % 7 == 0).alias("fallback_used"), *((n % (k + 2)).alias(c) for k, c in enumerate(names)))
    return _docs(spark, d).select("doc_id", F.array_join(extract.diagnostic_issues(made), ",").alias("issues"))


@query
def memory_counts(spark, d):
    """How many turns of each conversation are taken for their age, for their words, and not at all."""
    chosen = memory.select_memory(memory.completed_turns(_messages(spark, d)), _last_questions(spark, d), 1800, 900, 1, 2)
    return memory.selection_counts(chosen)


@query
def stale_operations(spark, d):
    """Messages as operations begun under the version of their place; conversations were invalidated as often as they have questions."""
    rows = _messages(spark, d).select(F.col("conv_id").cast("string").alias("key"), "msg_idx", (F.col("msg_idx") % 4).alias("version"), F.lit(0).cast("long").alias("all_version"))
    asked = _messages(spark, d).filter("role = 'user'").groupBy(F.col("conv_id").cast("string").alias("key")).agg(F.count("*").alias("version"))
    return operations.current(rows, asked).select("key", "msg_idx", "version")


@query
def markdown_normalize(spark, d):
    return _messages(spark, d).select("conv_id", "msg_idx", normalized_markdown(F.col("content")).alias("markdown"))


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in (SQL | FOLDS).items() if k in Q}
