"""The parsed document as a tree: a node for each heading, article, clause, point, table and loose block, with its parent.

A document is a row, whatever its id; ``row`` numbers them. All state of a reader that goes down the lines (which containers
are open, whether a table, an article or a signature came last, which title line a heading has taken) is a window over the
lines of a row, so a document is one sort and nothing is folded in Python. Nodes are named by the line they begin at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legispark.operators.structure import CONTAINERS, PATTERNS, STRUCTURAL, classify, looks_like_title, tables
from legispark.storage import drop, materialize

# White space as Unicode has it, headings that begin an appendix after a signature, marks around a title, and the longest inferred title.
SPACE = "".join(map(chr, (*range(9, 14), 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288)))
AFTER_SIGNATURE = r"(?iuU)^\s*(?:DANH\s+MỤC|BẢNG|BIỂU)(?:\s|$)"
TITLE_EDGES = r"^[ \t\r\n.:\-–—]+|[ \t\r\n.:\-–—]+$"
TITLE_WORDS = 18
MARKED = r"(?iuU)^\s*(\d{1,3}[a-zđ]?[.)]|[a-zđ]\d*[.)])"

EVENTS = (*STRUCTURAL, "table")
COUNTS = {"parts": "part", "chapters": "chapter", "sections": "section", "articles": "article", "clauses": "clause", "points": "point", "appendices": "appendix", "headings": "heading", "paragraphs": "paragraph", "list_items": "list_item", "tables": "table"}
# Characters of a text that is too long, of a document that one node may not fill, and warnings that are many.
OVERSIZE, LONG, MANY_WARNINGS = 50_000, 5_000, 20


def document_lines(docs: DataFrame) -> DataFrame:
    """(row, doc_id, line_no from 1, line): the lines of the text without white space around it; blank ones count but are dropped.

    ``row`` is a column of the documents if they have one, else a number of its own for each.
    """
    number = F.col("row") if "row" in docs.columns else F.monotonically_increasing_id()
    # Rows are dealt out before they are cut into lines, so that all that follows finds a document's lines in one partition.
    numbered = docs.select(number.alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("_text")).repartition("row")
    ends = F.replace(F.replace(F.btrim("_text", F.lit(SPACE)), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    lines = numbered.select("row", "doc_id", F.posexplode(F.split(ends, "\n")).alias("_i", "line"))
    return lines.select("row", "doc_id", (F.col("_i") + 1).cast("long").alias("line_no"), F.btrim("line", F.lit(SPACE)).alias("line")).filter("line <> ''")


def _since(kind: Column, own: Column, resets: tuple[str, ...], value: Column, run) -> Column:
    """The value of the last line that opens a level, null if one that closes it came after."""
    event = F.when(own, F.struct(value.alias("v"))).when(kind.isin(*resets), F.struct(F.lit(None).cast("struct<id:bigint,label:string>").alias("v")))
    return F.last(event, ignorenulls=True).over(run)["v"]


def read_lines(docs: DataFrame) -> DataFrame:
    """Lines with what a reader knows at each of them.

    ``kind``: as classified, but ``table`` for the line that opens a table and ``in_table`` for its other lines, and
    ``appendix`` for a heading after a signature that stands for one (``inferred``). ``taken``: the line is the title of the
    heading before it. ``appendix``, ``part``, ``chapter``, ``section``: the open containers (id, label). ``article`` and
    ``item``: the article that a line is in, and its last clause or point. ``first`` and ``previous``: the numbers of the
    document's first line and of the line before.
    """
    # All windows go down the lines of a row, so that one sort serves them; what they tell builds up in three steps.
    order = Window.partitionBy("row").orderBy("line_no")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    run, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    lines = classify(document_lines(docs)).withColumn("title", F.regexp_replace("title", TITLE_EDGES, ""))
    # A table runs from its first mark to the next end mark, whatever is between.
    lines = lines.withColumn("_open", F.last(F.when(F.col("kind").isin("table_start", "table_end"), F.col("kind")), ignorenulls=True).over(before))
    inside = F.coalesce(F.col("_open") == "table_start", F.lit(False))
    lines = lines.withColumn("mark", F.col("kind")).withColumn("kind", F.when(inside, "in_table").when(F.col("kind") == "table_start", "table").otherwise(F.col("kind")))
    kind = F.col("kind")
    me = lambda label: F.struct(F.col("line_no").alias("id"), label.alias("label"))
    named = me(F.coalesce(F.nullif("label", F.lit("")), F.col("line")))
    last = lambda *kinds: F.last(F.when(kind.isin(*kinds), F.col("line_no")), ignorenulls=True).over(run)
    # No title is a heading or an item, so containers, articles and items open whatever is taken for a title.
    known = {
        "_after": F.lag(F.when(F.col("title") == "", kind)).over(order), "previous": F.lag("line_no").over(order), "first": F.first("line_no").over(run), "structured": F.max(kind.isin(*EVENTS)).over(whole),
        "_last": F.last(F.when(kind.isin(*EVENTS), kind), ignorenulls=True).over(run), "_closed": F.last(F.when(kind.isin("signature", "appendix"), F.struct(kind.alias("kind"), named.alias("at"))), ignorenulls=True).over(run),
        "table_id": last("table"), "article": F.last(F.when(kind == "article", named), ignorenulls=True).over(run), "clause": last("numbered_item"), "item": last("numbered_item", "lettered_item"),
    }
    above: tuple[str, ...] = ("signature",)
    for level in CONTAINERS:
        if level != "appendix":
            known[level] = _since(kind, kind == level, above, named, run)
        above = (*above, level)
    lines = lines.withColumns(known).withColumn("table_id", F.when(kind.isin("table", "in_table"), F.col("table_id")))
    # A heading without a title takes the next line if that looks like one; an article asks for more.
    free = ~kind.isin("in_table", "table")
    loose = free & looks_like_title(F.col("line"), kind, most_words=TITLE_WORDS)
    tight = free & looks_like_title(F.col("line"), kind, strict=True, most_words=TITLE_WORDS)
    lines = lines.withColumn("_named", F.when(F.col("_after").isin(*CONTAINERS), loose).when(F.col("_after") == "article", tight).otherwise(False))
    # After a signature the first such heading outside an article is an appendix, until another begins.
    fits = F.when((kind == "free_heading") & (F.col("_closed.kind") == "signature") & (F.col("_last") != "article") & ~F.col("_named"), F.col("line").rlike(AFTER_SIGNATURE)).otherwise(False)
    # The latest stretch between signatures and appendices, and of that the first line.
    fitting = F.when(fits, F.struct(F.col("_closed.at.id").alias("after"), (-F.col("line_no")).alias("id"), "line"))
    lines = lines.withColumn("_fitting", fitting).withColumns({"_begun": F.max("_fitting").over(run), "_before": F.max("_fitting").over(before)["id"]})
    inferred = F.coalesce(F.col("_fitting").isNotNull() & (F.col("_begun.id") == -F.col("line_no")), F.lit(False))
    taken = F.when(F.col("_named"), True).when(F.col("_before") == -F.col("previous"), loose).otherwise(False)
    # An inferred appendix closes no container.
    stands = F.when(F.col("_begun.after") == F.col("_closed.at.id"), F.struct((-F.col("_begun.id")).alias("id"), F.col("_begun.line").alias("label"))).when(F.col("_closed.kind") == "appendix", F.col("_closed.at"))
    in_article = (F.col("_last") == "article") & ~kind.isin(*EVENTS, "in_table")
    lines = lines.withColumns({"inferred": inferred, "taken": taken & ~inferred, "appendix": stands, "article": F.when((kind == "article") | in_article, F.col("article"))})
    own = lambda c: F.when(~F.col("taken") & (F.col(c) > F.col("article.id")), F.col(c))
    lines = lines.withColumns({"clause": own("clause"), "item": own("item")})
    return lines.withColumn("kind", F.when(F.col("inferred"), "appendix").otherwise(kind)).drop("_open", "_after", "_closed", "_named", "_fitting", "_begun", "_before")


def _path() -> Column:
    return F.concat_ws("/", *(F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), F.col(c)["label"])) for c in CONTAINERS))


def document_tree(docs: DataFrame) -> DataFrame:
    """A row per node: row, doc_id, node_id, parent_id (null at the top), level (from 1), type, label, title,
    title_inferred, path (labels of the containers that are open), text, line_end, headers and rows (of tables).

    Types: preamble (lines before the first heading), part, chapter, section, appendix, article, clause, point, table, and
    heading, list_item, paragraph for lines that are none of these. Every line is in one node: as its heading or title, its
    text, or a line of its table. A document without text has no nodes.
    """
    # A node is put together where its document's lines lie, and takes the lines of its table along: the texts are shuffled
    # once, as documents, and no table of lines is kept.
    each = _node_lines(docs)
    own = lambda name: F.max(F.when(F.col("_type").isNotNull(), F.col(name))).alias(name.strip("_"))
    nodes = each.groupBy("row", "doc_id", F.col("_owner").alias("node_id")).agg(
        F.max(F.when(F.col("_type").isNotNull(), F.col("_parent"))).alias("parent_id"), own("_level"), F.max("_type").alias("type"), own("_label"), own("_title"), F.max("_taken").alias("_taken"), own("_path"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_text").isNotNull(), F.struct("line_no", F.col("_text").alias("t"))))), lambda x: x["t"]), "\n").alias("text"), F.max("line_no").alias("line_end"), F.collect_list("_mark").alias("_marks"),
    )
    nodes = _written(nodes.withColumn("title", F.when(F.col("type").isin(*CONTAINERS, "article"), F.coalesce("_taken", "title", F.lit("")))), "tree")
    has_table = F.size("_marks") > 0
    found = tables(nodes.filter(has_table).select(F.col("row").alias("doc_id"), F.inline("_marks"))).select(F.col("doc_id").alias("row"), F.col("line_start").alias("node_id"), "headers", "rows")
    plain = nodes.filter(~has_table)
    for c in ("headers", "rows"):
        plain = plain.withColumn(c, F.lit(None).cast(found.schema[c].dataType))
    whole = plain.unionByName(nodes.filter(has_table).join(found, ["row", "node_id"], "left"))
    return whole.select("row", "doc_id", "node_id", "parent_id", "level", "type", "label", "title", F.col("_taken").isNotNull().alias("title_inferred"), "path", "text", "line_end", "headers", "rows")


def _node_lines(docs: DataFrame) -> DataFrame:
    """Lines with the node that each belongs to (``_owner``), and at the line that begins a node what it is."""
    lines = read_lines(docs)
    kind, line = F.col("kind"), F.col("line")
    before = F.col("structured") & F.col("_last").isNull()
    # The node that each line belongs to, and the type of those that begin one.
    begins = F.when(kind.isin(*CONTAINERS, "article", "table"), kind).when(kind == "signature", "heading")
    item = F.when(F.col("item") == F.col("line_no"), F.when(kind == "numbered_item", "clause").otherwise("point"))
    block = F.when(kind == "free_heading", "heading").when(kind.isin("numbered_item", "lettered_item", "bullet"), "list_item").otherwise("paragraph")
    owner = F.when(F.col("table_id").isNotNull(), F.col("table_id")).when(before, F.col("first")).when(F.col("taken"), F.col("previous")).when(F.col("article").isNotNull(), F.coalesce("item", "article.id")).otherwise(F.col("line_no"))
    kind_of = F.when(before, "preamble").when(begins.isNotNull(), begins).when(F.col("article").isNotNull(), item).otherwise(block)
    containers = F.coalesce(*(F.col(c)["id"] for c in reversed(CONTAINERS)))
    higher = {"appendix": F.lit(None).cast("long"), "part": F.col("appendix.id"), "chapter": F.coalesce("part.id", "appendix.id"), "section": F.coalesce("chapter.id", "part.id", "appendix.id")}
    parent = F.when(kind == "signature", F.lit(None)).when(F.col("_type").isin("clause", "point"), F.when(kind == "lettered_item", F.coalesce("clause", "article.id")).otherwise(F.col("article.id")))
    for name, value in higher.items():
        parent = parent.when(kind == name, value)
    parent = parent.when(F.col("_type") == "preamble", F.lit(None)).otherwise(containers)
    # A line's depth: the containers above it; an appendix is one if it began before the others.
    outer = F.coalesce((F.col("appendix.id") < F.coalesce("part.id", "chapter.id", "section.id", "line_no")).cast("int"), F.lit(0))
    above = lambda *levels: sum((F.col(c).isNotNull().cast("int") for c in levels), outer)
    depth = F.when(F.col("_type").isin("preamble", "appendix") | (kind == "signature"), F.lit(1))
    for name, levels in (("part", ()), ("chapter", ("part",)), ("section", ("part", "chapter"))):
        depth = depth.when(kind == name, 1 + above(*levels))
    inside = F.when(F.col("_type") == "clause", 1).when(F.col("_type") == "point", F.when(F.col("clause").isNotNull(), 2).otherwise(1)).otherwise(0)
    depth = depth.otherwise(1 + above("part", "chapter", "section") + inside)
    label = F.when(kind.isin(*CONTAINERS), F.when(F.col("inferred"), line).otherwise(F.coalesce(F.nullif("label", F.lit("")), line))).when(kind == "article", F.col("label"))
    label = label.when(F.col("_type") == "clause", F.regexp_extract(line, PATTERNS["numbered_item"], 1)).when(F.col("_type") == "point", F.regexp_extract(line, PATTERNS["lettered_item"], 1))
    label = label.when(F.col("_type") == "list_item", F.when(kind == "bullet", "-").otherwise(F.regexp_extract(line, MARKED, 1)))
    rest = F.when(F.col("_type").isin("clause", "list_item") & (kind == "numbered_item"), F.regexp_extract(line, PATTERNS["numbered_item"], 2)).when(F.col("_type").isin("point", "list_item") & (kind == "lettered_item"), F.regexp_extract(line, PATTERNS["lettered_item"], 2))
    rest = rest.when((F.col("_type") == "list_item") & (kind == "bullet"), F.regexp_extract(line, PATTERNS["bullet"], 1)).when(F.col("_type").isin(*CONTAINERS, "article", "table"), F.lit(None)).otherwise(line)
    each = lines.withColumn("_owner", owner).withColumn("_type", F.when(owner == F.col("line_no"), kind_of))
    text = F.when(F.col("taken") | (kind == "in_table"), F.lit(None)).otherwise(rest)
    marked = F.when(F.col("table_id").isNotNull(), F.struct("line_no", F.col("mark").alias("kind"), "line"))
    return each.select("row", "doc_id", "line_no", "_owner", "_type", marked.alias("_mark"), parent.alias("_parent"), depth.alias("_level"), label.alias("_label"), F.when(~F.col("inferred"), F.col("title")).alias("_title"), F.when(F.col("taken"), line).alias("_taken"), _path().alias("_path"), F.nullif(F.trim(text), F.lit("")).alias("_text"), before.alias("_front"))


def _outline(docs: DataFrame) -> DataFrame:
    """The nodes without their texts, written down: what counts and warnings are read from.

    Columns: row, doc_id, node_id, type, parent_id and label (of articles, clauses and points), path (of articles), size (of
    the text), preamble (its lines with their numbers) and marks (the lines of a table).
    """
    at = lambda name, *types: F.max(F.when(F.col("_type").isin(*types), F.col(name))).alias(name.strip("_"))
    size = F.greatest(F.coalesce(F.sum(F.length("_text") + 1), F.lit(0)) - 1, F.lit(0))
    nodes = _node_lines(docs).groupBy("row", "doc_id", F.col("_owner").alias("node_id")).agg(
        F.max("_type").alias("type"), at("_parent", "clause", "point").alias("parent_id"), at("_label", "article", "clause", "point"), at("_path", "article"), size.alias("size"),
        F.collect_list(F.when(F.col("_front") & F.col("_text").isNotNull(), F.struct("line_no", F.col("_text").alias("line")))).alias("preamble"), F.collect_list("_mark").alias("marks"),
    )
    return _written(nodes, "tree")


def _written(df: DataFrame, name: str) -> DataFrame:
    """Written down with steps run one by one where their expressions together are too long for Java to compile (8000 bytes)."""
    conf, key = df.sparkSession.conf, "spark.sql.codegen.hugeMethodLimit"
    usual = conf.get(key)
    conf.set(key, "8000")
    try:
        return materialize(df, name)
    finally:
        conf.set(key, usual)


def tree_warnings(docs: DataFrame) -> DataFrame:
    """(row, doc_id, node_id, warning): numbers that repeat, articles without a body, and what is wrong with tables.

    A repeated article is told at the first of those that share a number and a path.
    """
    return _warnings(_outline(docs))


def _warnings(outline: DataFrame) -> DataFrame:
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)).alias("warning")
    lower = F.lower("label")
    # What hangs on an article or a clause: its clauses and points by number.
    children = outline.filter("type IN ('clause', 'point')").select("row", F.col("parent_id").alias("node_id"), "type", lower.alias("n"))
    numbered = children.groupBy("row", "node_id", "type", "n").agg(F.count(F.lit(1)).alias("c"))
    again = lambda t: F.coalesce(F.bool_or((F.col("type") == t) & (F.col("c") > 1)), F.lit(False)).alias(t)
    held = numbered.groupBy("row", "node_id").agg(again("clause"), again("point"), F.lit(True).alias("held"))
    nodes = outline.filter("type IN ('article', 'clause')").select("row", "doc_id", "node_id", "parent_id", "type", "label", "size").join(held, ["row", "node_id"], "left")
    articles = nodes.filter("type = 'article'")
    bad = F.array_compact(F.array(F.when(F.col("clause"), say("duplicate_clause_number:article=", F.col("label"))), F.when(F.col("point"), say("duplicate_direct_point_number:article=", F.col("label"))), F.when(F.col("held").isNull() & (F.col("size") == 0), say("article_without_body:", F.col("label")))))
    of = outline.filter("type = 'article'").select("row", F.col("node_id").alias("parent_id"), F.col("label").alias("_article"))
    same = outline.filter("type = 'article'").groupBy("row", "doc_id", "path", lower.alias("n")).agg(F.min("node_id").alias("node_id"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    # Rows are told apart also where two have the same id.
    marks = outline.filter("type = 'table'").select(F.struct("row", "doc_id").alias("doc_id"), F.inline("marks"))
    out = [
        articles.select("row", "doc_id", "node_id", F.explode(bad).alias("warning")),
        nodes.filter("type = 'clause' AND point").join(of, ["row", "parent_id"]).select("row", "doc_id", "node_id", say("duplicate_point_number:article=", F.col("_article"), ",clause=", F.col("label"))),
        same.select("row", "doc_id", "node_id", say("duplicate_article_number:article=", F.col("n"), ",count=", F.col("c").cast("string"), ",path=", F.col("path"))),
        tables(marks).select("doc_id.row", "doc_id.doc_id", F.col("line_start").alias("node_id"), F.explode("warnings").alias("warning")),
    ]
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


def parsed(docs: DataFrame, status: str | None = None) -> DataFrame:
    """A row per document: row, doc_id, preamble, counts of its nodes, structure_type, parser_status, warnings, quality_flags
    and parse_quality. With ``status``, the name of a column, only documents whose status is ``ok`` are read; those and
    documents without text are ``skipped_no_text`` and their structure is ``empty``.
    """
    usable = F.col(status) == "ok" if status else F.lit(True)
    kept = docs.select("doc_id", F.when(F.coalesce(usable, F.lit(False)), F.col("text")).alias("text"), F.coalesce(F.length("text"), F.lit(0)).alias("_size"))
    # Rows are numbered once and written with their numbers.
    held = materialize(kept.withColumn("row", F.monotonically_increasing_id()), "parsed")
    every = materialize(held.select("row", "doc_id", "_size"), "documents")
    outline = _outline(held)
    drop(held)
    is_ = lambda *names: F.col("type").isin(*names)
    own = outline.groupBy("row").agg(F.max(F.when(~is_("preamble", "clause", "point"), F.col("size"))).alias("_largest"), F.max(F.when(is_("article"), F.col("size"))).alias("_article"), *(F.count_if(is_(v)).alias(k) for k, v in COUNTS.items()), F.max(F.lit(True)).alias("_nodes"))
    front = outline.filter(is_("preamble")).select("row", F.array_join(F.transform(F.array_sort("preamble"), lambda x: x["line"]), "\n").alias("preamble"))
    told = _warnings(outline).groupBy("row").agg(F.array_sort(F.collect_list("warning")).alias("warnings"))
    x = every.join(own, "row", "left").join(front, "row", "left").join(told, "row", "left").fillna(0, list(COUNTS)).withColumns({"warnings": F.coalesce("warnings", F.array().cast("array<string>")), "_nodes": F.coalesce("_nodes", F.lit(False))})
    x = x.withColumn("preamble", F.coalesce("preamble", F.lit("")))
    nested = F.col("parts") + F.col("chapters") + F.col("sections") > 0
    articles, appendices = F.col("articles") > 0, F.col("appendices") > 0
    shape = F.when(~F.col("_nodes"), "empty").when(articles & nested & appendices, "mixed_hierarchical").when(articles & nested, "hierarchical_article_based").when(articles & appendices, "mixed_article_appendix").when(articles, "article_based")
    shape = shape.when(appendices, "appendix_or_form").when(nested, "hierarchical_no_articles").when(F.col("headings") + F.col("list_items") + F.col("tables") > 0, "semi_structured").otherwise("free_form")
    many = F.size("warnings")
    flags = F.array_compact(F.array(
        F.when(F.length("preamble") > OVERSIZE, "severe:oversized_preamble"),
        F.when(F.col("_article") > OVERSIZE, "severe:oversized_article_text"),
        F.when((F.col("_size") > LONG) & (F.col("_largest") > F.col("_size") * 0.8), "severe:single_node_dominates_document"),
        F.when(many >= MANY_WARNINGS, "severe:many_parser_warnings").when(many > 0, "parser_warnings"),
    ))
    x = x.withColumns({"structure_type": shape, "parser_status": F.when(F.col("_nodes"), "ok").otherwise("skipped_no_text"), "quality_flags": flags})
    quality = F.when(F.exists("quality_flags", lambda f: f.startswith("severe:")), "quarantine").when(F.size("quality_flags") > 0, "review").otherwise("ok")
    return x.withColumn("parse_quality", quality).drop("_nodes", "_largest", "_article", "_size")
